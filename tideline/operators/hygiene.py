"""Ingestion hygiene: normalising, cleaning, upserting, freshness, routing of bar datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import add

BAR_SCHEMA = "ts timestamp, symbol string, open double, high double, low double, close double, volume double, spread_points int"
STALE_DAYS = {"D1": 4, "H4": 2, "H1": 2}

# fixed values: symbol code lists
CURRENCIES = (
    "AED AMD AOA ARS AUD AZN BDT BGN BHD BND BRL CAD CHF CLP CNH CNY COP CZK DKK DZD EGP EUR GBP GEL GHS GTQ HKD HNL HRK HUF IDR ILS INR IQD "
    "ISK JMD JOD JPY KES KGS KRW KWD KZT LBP LKR MAD MXN MYR NGN NOK NPR NZD OMR PEN PHP PKR PLN QAR RON RUB RUR SAR SEK SGD SYP "
    "THB TJS TMT TND TRY TTD TWD UAH UGX USD UZS VND VUV XCD XOF ZAR ZMW"
).split()
CRYPTO = "1INCH AAVE ADA BAT BCH BNB BTC BWP CAKE COMP DOGE DOT ETH FIL HBAR HT IOST LINK LTC MBT SOL TET UNI XEM XLM XRP XTZ".split()
METALS = "XAU XAG XPT XPD".split()
COMMODITIES = "XAL XBR XCK XCO XCU XNG XNI XPB XSN XTI XZN USOIL WTICO BRENT".split()
INDICES = "AUS200 CHN50 ESP35 FRA40 GER30 HKG50 IN50 IND50 DXY JPN225 SPA35 SWI20 UK100 US30 US500 USTEC US30_x10 US500_x100 USTEC_x100".split()


def _in(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(repr(v) for v in values)})"


_S3, _FX = "substr(symbol, 1, 3)", f"length(symbol) = 6 AND {_in('substr(symbol, 1, 3)', CURRENCIES)} AND {_in('substr(symbol, 4, 3)', CURRENCIES)}"
_COMM = f"{_in(_S3, COMMODITIES)} OR {_in('symbol', COMMODITIES)}"


def _digits(like: str) -> str:
    return f"{_in('symbol', INDICES)} OR ({like} AND symbol NOT LIKE '%USD')"


def classify_sql(has_digit: str, member: str = "false") -> str:
    """Dataset group of a symbol; the first rule that matches wins."""
    usd = f"(symbol LIKE '%USDT' AND NOT {_in('substr(symbol, 1, length(symbol) - 4)', CURRENCIES)}) OR (symbol LIKE '%USD' AND NOT {_in('substr(symbol, 1, length(symbol) - 3)', CURRENCIES)})"
    return f"""CASE WHEN {member} THEN 'equity_universe' WHEN {_in(_S3, METALS)} THEN 'metals' WHEN {_COMM} THEN 'commodities'
        WHEN {_digits(has_digit)} THEN 'indices' WHEN {_in('substr(symbol, 1, 4)', CRYPTO)} OR {_in(_S3, CRYPTO)} THEN 'crypto' WHEN {usd} THEN 'crypto'
        WHEN {_FX} THEN 'full_fx' ELSE 'equity' END"""


def macro_class_sql(has_digit: str) -> str:
    """Macro class of a symbol; here FX is tested before commodities and crypto before indices."""
    return f"""CASE WHEN {_in(_S3, METALS)} THEN 'metal' WHEN {_FX} THEN 'fx' WHEN {_COMM} THEN 'commodity'
        WHEN {_in('symbol', CRYPTO)} OR {_in(_S3, CRYPTO)} OR (symbol LIKE '%USD' AND NOT {_in('substr(symbol, 1, length(symbol) - 3)', CURRENCIES)}) THEN 'crypto'
        WHEN {_digits(has_digit)} THEN 'index' ELSE 'equity' END"""


def clean_bars(raw: DataFrame, ordinal: str = "ord") -> DataFrame:
    """First row per (symbol, ts), positive and consistent prices, volume filled forward over at most two rows.

    The first row is found by a map-side-combined aggregate, so a hot timestamp is one row per map
    task before the shuffle. The fill looks two rows back, hence a two-row halo.
    """
    from . import panel as P

    cols = [c for c in raw.columns if c not in ("symbol", "ts", ordinal)]
    one = raw.groupBy("symbol", "ts").agg(F.expr(f"min_by(struct({', '.join(cols)}), {ordinal}) AS _r")).select("symbol", "ts", "_r.*")
    ok = one.where(
        "open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND high >= open AND high >= close AND low <= open AND low <= close"
    )
    h = P.chunked(ok, 2)
    return P.put(P.own_rows(P.put(h, {"volume": f"last(volume, true) {P.over(2)}"})), {}).drop("_c")


def normalise_rates(rates: DataFrame) -> DataFrame:
    """Terminal rows (epoch seconds, tick_volume, spread) to the bar schema."""
    return rates.selectExpr(
        "timestamp_seconds(time) AS ts", "symbol", "open", "high", "low", "close", "coalesce(cast(tick_volume as double), 0.0D) AS volume",
        "coalesce(cast(spread as int), 0) AS spread_points",
    )


def parse_payload(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Chart payload JSON with parallel arrays to bar rows; rows without a positive price are dropped."""
    schema = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
    p = payloads.selectExpr("symbol", f"from_json({col}, '{schema}') AS p")
    z = p.selectExpr("symbol", "inline(arrays_zip(p.timestamp, p.open, p.high, p.low, p.close, p.volume))")
    return z.selectExpr("symbol", "timestamp_seconds(timestamp) AS ts", "open", "high", "low", "close", "coalesce(volume, 0.0D) AS volume").where(
        "open > 0 AND high > 0 AND low > 0 AND close > 0"
    )


def upsert(old: DataFrame, new: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Union where the newer source wins per key (one partial aggregate, no sort)."""
    u = add(old, {"_src": "0"}).unionByName(add(new, {"_src": "1"}))
    cols = ", ".join(c for c in old.columns if c not in keys)
    return u.groupBy(*keys).agg(F.expr(f"max_by(struct({cols}), _src) AS _r")).select(*keys, "_r.*")


def update_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per symbol: created / updated / current and the number of added bars."""
    added = new.join(old.select("symbol", "ts"), ["symbol", "ts"], "left_anti").groupBy("symbol").agg(F.expr("count(*) AS added"))
    have = old.groupBy("symbol").agg(F.expr("count(*) AS had"))
    seen = new.groupBy("symbol").agg(F.expr("count(*) AS fetched"))
    d = seen.join(have, "symbol", "left").join(added, "symbol", "left")
    return d.selectExpr(
        "symbol", "coalesce(added, 0) AS added",
        "CASE WHEN had IS NULL THEN 'created' WHEN coalesce(added, 0) > 0 THEN 'updated' ELSE 'current' END AS status",
    )


def dataset_counts(bars: DataFrame) -> DataFrame:
    """One row per (grp, timeframe, symbol): bars, first and last timestamp."""
    return bars.groupBy("grp", "timeframe", "symbol").agg(F.expr("count(*) AS n"), F.expr("min(ts) AS first_ts"), F.expr("max(ts) AS last_ts"))


def longest_copy(counts: DataFrame) -> DataFrame:
    """Among copies of a symbol and timeframe in several groups keep the one with most bars."""
    return counts.groupBy("timeframe", "symbol").agg(F.expr("max_by(struct(grp, n), struct(n, grp)) AS b")).selectExpr("timeframe", "symbol", "b.grp AS grp", "b.n AS n")


def merge_plan(staged: DataFrame, existing: DataFrame) -> DataFrame:
    """Action per staged dataset: longer copies move, shorter are skipped, unreadable keep both."""
    s = staged.selectExpr("symbol", "timeframe", "n AS n_new")
    e = existing.selectExpr("symbol", "timeframe", "n AS n_old")
    return s.join(e, ["symbol", "timeframe"], "full").selectExpr(
        "symbol", "timeframe", "n_new", "n_old",
        "CASE WHEN n_new IS NULL THEN 'keep' WHEN n_old IS NULL THEN 'move' WHEN n_new = 0 OR n_old = 0 THEN 'keep-both' WHEN n_new > n_old THEN 'move' ELSE 'skip-shorter' END AS action",
    )


def freshness(counts: DataFrame, expected: DataFrame, today: str) -> DataFrame:
    """FRESH / STALE / MISSING per expected dataset on the given day."""
    limit = "CASE timeframe " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STALE_DAYS.items()) + " ELSE 4 END"
    d = expected.join(counts.select("timeframe", "symbol", "n", "last_ts"), ["timeframe", "symbol"], "left")
    d = add(d, {"age": f"datediff(DATE '{today}', to_date(last_ts))"})
    return add(d, {"status": f"CASE WHEN n IS NULL THEN 'MISSING' WHEN age > {limit} THEN 'STALE' ELSE 'FRESH' END"})


# fixed values: the members of the research buckets
BUCKET_MAJORS = "EUR GBP USD CHF JPY AUD NZD CAD".split()
BUCKETS = {"metal": "XAUUSD XAGUSD XPTUSD XPDUSD".split(), "crypto": "BTCUSD ETHUSD".split(), "index": "US500 US30 USTEC NAS100 US100".split()}


def symbol_bucket(symbol: str = "symbol") -> str:
    """Research bucket of a symbol: a listed member, else a cross of two majors, else exotic; null stays null."""
    listed = " ".join(f"WHEN {_in(symbol, names)} THEN '{k}'" for k, names in BUCKETS.items())
    return f"CASE WHEN {symbol} IS NULL THEN NULL {listed} WHEN {_in(f'substr({symbol}, 1, 3)', BUCKET_MAJORS)} AND {_in(f'substr({symbol}, 4)', BUCKET_MAJORS)} THEN 'fx_major_cross' ELSE 'fx_exotic' END"
