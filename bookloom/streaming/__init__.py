"""The sequencing kernel over streams of snapshots."""
