"""Market constants.

Fixed values: session times, product sizes and code prefixes that results depend on.
"""

AUCTION_START = "09:15:00.000"
AUCTION_SECOND_STAGE_START = "09:20:00.000"
AUCTION_SECOND_STAGE_END = "09:25:00.000"
SESSION_START = "09:30:00.000"
VALID_DATA_START = "09:32:00.000"
NOON_END = "11:30:00.000"
NOON_START = "13:00:00.000"
CLOSING_AUCTION_START = "14:57:00.000"
SESSION_END = "15:00:00.000"

NOON_BREAK_SECONDS = 5400
STOCK_TICK_SECONDS = 3
FUTURE_TICK_SECONDS = 0.5
TICKS_PER_SESSION = 4800
BARS_PER_MINUTE = 20

RETURN_MINUTES = (1, 2, 5, 10, 20, 30)

# constituents per index product
INDEX_SIZES = {"IC": 500, "IF": 300, "IH": 50}

RESULT_OK = 0
RESULT_FAILED = 1
STATUS_OK = 0
STATUS_SUSPENDED = 1
STATUS_BAD_DATA = 2
IS_MAIN = 0

BOOK_DEPTH = 10
LIMIT_TOLERANCE = 0.001

# positional columns of the level-2 stock tick file
STOCK_TICK_COLUMNS = (
    ["tscode", "exchange_tscode", "date", "time", "price", "volume", "amount", "transaction_number",
     "iopv", "transaction_flag", "bs_flag", "daily_accumulated_volume", "daily_amount",
     "high", "low", "open", "close"]
    + [f"ask_price{i}" for i in range(1, 11)]
    + [f"ask_volume{i}" for i in range(1, 11)]
    + [f"bid_price{i}" for i in range(1, 11)]
    + [f"bid_volume{i}" for i in range(1, 11)]
    + ["weighted_average_ask_price", "weighted_average_bid_price", "total_ask_volume", "total_bid_volume",
       "unweighted_index", "total_varieties", "total_increase_varieties", "total_falling_varieties",
       "total_equal_varieties"]
)
UNUSED_STOCK_TICK_COLUMNS = ("iopv", "total_varieties", "total_increase_varieties",
                             "total_falling_varieties", "total_equal_varieties")
