"""Record and pair validation, duplicate detection (VAL1-VAL3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.binding import select_once
from duelbook.functions.names import clean_name, name_key
from duelbook.functions.results import RESULTS, home_result, mirrored
from duelbook.functions.times import parse_utc
from duelbook.operators.merge import QUALITY_ORDER
from duelbook.schemas import HISTORY_FIELDS

# The closed sets of the stored record.
LEAGUES = ("GT", "EADRIATIC")
SIDES = ("home", "away")
PRECISIONS = ("second", "minute")
SCHEMA_VERSION = 1
# What both perspectives of one match must agree on.
SHARED_FIELDS = (
    "schema_version", "league", "match_id", "native_match_id", "timestamp", "timestamp_utc", "timestamp_precision",
    "timezone", "timezone_inferred", "home_score", "away_score", "source_type", "source_file", "data_quality",
    "competition", "round", "group_key", "group_players", "source_block_order", "source_row_order", "collected_at",
)
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"


def _ok(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def record_errors(df: DataFrame) -> DataFrame:
    """Add ``errors``: the name of every rule the row breaks (empty when valid).

    Stamps are parsed once a row and rules checked once, however often later filters mention them.
    """
    c = F.col
    expected = home_result(c("home_score"), c("away_score"))
    expected = F.when(c("home_away") == "away", mirrored(expected)).otherwise(expected)
    folded = df.withColumns({"_pc": clean_name("player"), "_rc": clean_name("rival"),
                             "_pk": name_key("player"), "_rk": name_key("rival")})
    keyed = select_once(folded, *folded.columns, parse_utc(c("timestamp")).alias("_t"), parse_utc(c("timestamp_utc")).alias("_u"))
    rules = {
        **{f"missing {f.name}": c(f.name).isNotNull() for f in HISTORY_FIELDS},
        "schema_version": c("schema_version") == SCHEMA_VERSION,
        "league": c("league").isin(*LEAGUES),
        "result": c("result").isin(*RESULTS),
        "home_away": c("home_away").isin(*SIDES),
        "timestamp_precision": c("timestamp_precision").isin(*PRECISIONS),
        "data_quality": c("data_quality").isin(*QUALITY_ORDER),
        "timezone": c("timezone") != "",
        "scores": (c("home_score") >= 0) & (c("away_score") >= 0),
        "names not normalized": (c("player") == c("_pc")) & (c("rival") == c("_rc")),
        "keys not normalized": (c("player_key") == c("_pk")) & (c("rival_key") == c("_rk")),
        "perspective_id": c("perspective_id") == F.concat_ws(":", "match_id", "_pk"),
        "match_id prefix": F.startswith(c("match_id"), F.concat(F.lower("league"), F.lit(":"))),
        "source": (c("source_type") != "") & (c("source_file") != ""),
        "timestamp": F.regexp_like(c("timestamp"), F.lit(_OFFSET)) & c("_t").isNotNull(),
        "timestamp_utc": F.endswith(c("timestamp_utc"), F.lit("Z")) & c("_u").isNotNull(),
        "instants differ": c("_t") == c("_u"),
        "result against score": c("result") == expected,
    }
    errors = F.array_compact(F.array(*[F.when(~_ok(rule), F.lit(name)) for name, rule in rules.items()]))
    return select_once(keyed, *df.columns, errors.alias("errors"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``errors``)."""
    checked = record_errors(df)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def error_counts(df: DataFrame) -> DataFrame:
    """How often each rule is broken."""
    return record_errors(df).select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def require_valid(df: DataFrame) -> DataFrame:
    """The same rows; the query fails at the first invalid one."""
    checked = record_errors(df)
    message = F.concat(F.lit("invalid record "), F.coalesce("perspective_id", F.lit("?")), F.lit(": "), F.array_join("errors", ", "))
    guard = F.when(F.size("errors") > 0, F.raise_error(message)).otherwise(F.lit(True).cast("string"))
    return checked.filter(guard.isNotNull()).drop("errors")


def pair_errors(df: DataFrame) -> DataFrame:
    """(match_id, errors) of matches whose two perspectives do not mirror each other.

    One aggregation per match, combined map-side: per field only the lowest and highest
    value and a null count travel, so a match with very many copies stays small.  The id's
    hash leads the sort, as ids begin alike.
    """
    shared = [f for f in SHARED_FIELDS if f in df.columns and f != "match_id"]
    home, away = F.col("home_away") == "home", F.col("home_away") == "away"
    per_side = {}
    for side, cond in (("h", home), ("a", away)):
        for f in ("result", "player_key", "rival_key"):
            per_side[f"{side}_{f}"] = F.max(F.when(cond, F.col(f)))
    g = df.groupBy(F.xxhash64("match_id").alias("_hash"), "match_id").agg(
        F.count("*").alias("n"), F.count_if(home).alias("n_home"), F.count_if(away).alias("n_away"),
        *[F.struct(F.min(F.col(f)).alias("lo"), F.max(F.col(f)).alias("hi"), F.count(F.col(f)).alias("k")).alias(f) for f in shared],
        *[v.alias(k) for k, v in per_side.items()],
    )
    expected = home_result(F.col("home_score.lo"), F.col("away_score.lo"))
    rules = {
        "not two perspectives": F.col("n") == 2,
        "not one home and one away": (F.col("n_home") == 1) & (F.col("n_away") == 1),
        **{f"disagree on {f}": (F.col(f)["k"] == 0) | ((F.col(f)["k"] == F.col("n")) & (F.col(f)["lo"] == F.col(f)["hi"]))
           for f in shared},
        "results not symmetric": (F.col("h_result") == expected) & (F.col("a_result") == mirrored(expected)),
        "players not symmetric": (F.col("h_player_key") == F.col("a_rival_key")) & (F.col("a_player_key") == F.col("h_rival_key")),
    }
    errors = F.array_compact(F.array(*[F.when(~_ok(rule), F.lit(name)) for name, rule in rules.items()]))
    return g.select("match_id", errors.alias("errors")).filter(F.size("errors") > 0)


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Non-blank perspective ids that occur more than once, with their count."""
    return (df.filter(F.col("perspective_id") != "").groupBy("perspective_id")
            .agg(F.count("*").alias("copies")).filter("copies > 1"))
