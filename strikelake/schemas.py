"""Fixed table schemas. Prices are DOUBLE, volumes and open interest BIGINT, everywhere.

The strike is part of every series key, so it is an exact DECIMAL: Spark normalises floating-point
keys operator by operator, and rows hashed by a DOUBLE key are shuffled again at the next one.
"""

from pyspark.sql import types as T

STRIKE = T.DecimalType(18, 4)

# The column names and order of the instrument master and the candle table.
INSTRUMENTS = T.StructType([
    T.StructField("instrument_token", T.LongType()),
    T.StructField("exchange_token", T.StringType()),
    T.StructField("tradingsymbol", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("last_price", T.DoubleType()),
    T.StructField("expiry", T.DateType()),
    T.StructField("strike", STRIKE),
    T.StructField("tick_size", T.DoubleType()),
    T.StructField("lot_size", T.IntegerType()),
    T.StructField("instrument_type", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("exchange", T.StringType()),
])

CANDLES = T.StructType([
    T.StructField("instrument_token", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("expiry", T.DateType()),
    T.StructField("strike", STRIKE),
    T.StructField("instrument_type", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("oi", T.LongType()),
    T.StructField("day", T.DateType()),
])

OPTIONS_SEGMENT = "NFO-OPT"
FUTURES_SEGMENT = "NFO-FUT"
EXCHANGE = "NFO"
CALL = "CE"
PUT = "PE"

# A series is one straddle; a leg is one side of it.
SERIES = ["name", "expiry", "strike"]
LEG = ["name", "expiry", "strike", "instrument_type", "instrument_token"]


def as_landing(schema: T.StructType) -> T.StructType:
    """The same columns as text: what a landed CSV or JSON file is read with before casting."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
