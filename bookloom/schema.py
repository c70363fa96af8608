"""Row shapes: raw snapshots and ladder levels."""

from __future__ import annotations

LEVEL = "struct<price_paise: bigint, price: double, quantity: bigint, orders: bigint>"
RAW = (
    "token string, symbol string, exchange_type int, exchange_timestamp_ms bigint, sequence_number bigint, last_traded_price double, "
    "last_traded_quantity bigint, average_traded_price double, volume_traded_today bigint, total_buy_quantity double, total_sell_quantity double, "
    f"open_price double, high_price double, low_price double, close_price double, bids array<{LEVEL}>, asks array<{LEVEL}>"
)
