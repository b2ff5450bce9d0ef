"""Same or nearly the same records across splits: an exact prefix-filter join of shingle sets, evaluation side indexed, training side probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import salted_join
from evalloom.session import cut_lineage


def parse_metres(c: Column) -> Column:
    """A length text in metres: '1.2', '1,2', '~1.2 metres', '120 cm', '1200mm'; metres if no unit stands there. Null if it has no number."""
    number = F.regexp_extract(F.regexp_replace(c, ",", "."), r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
    value = F.when(number != "", number.cast("double"))
    unit = F.lower(F.regexp_extract(c, r"[0-9]\s*(mm|cm|m)", 1))
    return F.when(unit == "mm", value / 1000).when(unit == "cm", value / 100).otherwise(value)


def numbered(tokens: Column) -> Column:
    """The tokens sorted, each with how often it occurred before it: a set that stands for the multiset."""
    ordered = F.array_sort(tokens)
    return F.transform(ordered, lambda t, i: F.concat(t, F.lit("\x1f"), (i - F.array_position(ordered, t) + 1).cast("string")))


def _least_shared(n: Column, m: Column, share: float) -> Column:
    """Tokens that sets of ``n`` and ``m`` tokens must share for a Jaccard similarity of ``share``."""
    return F.ceil(F.lit(share / (1 + share)) * (n + m) - 1e-9)


def similar_sets(index: DataFrame, probes: DataFrame, share: float = 1.0) -> DataFrame:
    """(place, a, b): all pairs of a set of ``index`` and one of ``probes`` with the same place and a Jaccard similarity of at least ``share`` (above 0).

    Both have (place, set): distinct, not null, sets as arrays of distinct tokens. An exact prefix-filter join: shingles (place, token) are ordered by their
    frequency in the index, rare ones first (ties by the token, so that the order is one and the same everywhere). Similar sets of n tokens must
    share one of the first n - ceil(share * n) + 1 shingles of each, so only those of the index are kept and only those of the probes look there. What they
    meet passes the length filter (share * n <= m <= n / share) and the position filter (the tokens from the two positions on still suffice). The first shared
    shingle of a pair alone speaks for it, so a pair comes once; then the token lists themselves are compared. Probes without a shingle in the
    index leave at the look-up of frequencies.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")

    def shingles(df: DataFrame) -> DataFrame:
        return df.select("place", "set", F.explode("set").alias("token"))

    counts = shingles(index).groupBy("place", "token").agg(F.count(F.lit(1)).alias("df")).withColumn("_k", F.xxhash64("place", "token"))
    small = counts.select("_k", F.col("place").alias("_p"), F.col("token").alias("_t"), "df")

    def ordered(df: DataFrame) -> DataFrame:
        """(place, set, ranked): the shingles of each set as (df, token), rare ones first; 0 where the index has none."""
        rows = shingles(df).withColumn("_k", F.xxhash64("place", "token"))
        # A token that most sets of a hot place have is spread over salts; the hash is checked by the values.
        found = salted_join(rows, small, "_k", F.xxhash64("set"), how="left")
        seen = F.when((F.col("place") == F.col("_p")) & (F.col("token") == F.col("_t")), F.col("df")).otherwise(F.lit(0))
        each = found.select("place", "set", F.struct(seen.alias("df"), F.col("token").alias("token")).alias("_s"))
        return each.groupBy("place", "set").agg(F.array_sort(F.collect_list("_s")).alias("ranked"))

    def prefixes(df: DataFrame) -> DataFrame:
        n = F.size("ranked")
        first = df.select("place", "ranked", n.alias("n"), F.posexplode(F.slice("ranked", 1, n - F.ceil(n * F.lit(share) - 1e-9).cast("int") + 1)).alias("i", "s"))
        return first.where(F.col("s.df") > 0).select("place", "n", "i", F.col("s.token").alias("token"), F.transform("ranked", lambda x: x["token"]).alias("list"))

    a, b = prefixes(ordered(index)).alias("a"), prefixes(ordered(probes)).alias("b")
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.token") == F.col("b.token")))
    n, m = F.col("a.n"), F.col("b.n")
    length = (m >= n * F.lit(share) - 1e-9) & (n >= m * F.lit(share) - 1e-9)
    position = F.least(n - F.col("a.i"), m - F.col("b.i")) >= _least_shared(n, m, share)
    common = F.array_intersect(F.col("a.list"), F.col("b.list"))
    verified = (common[0] == F.col("a.token")) & (F.size(common) >= _least_shared(n, m, share))
    pairs = met.where(length & position).where(verified)
    return pairs.select(F.col("a.place").alias("place"), F.array_sort("a.list").alias("a"), F.array_sort("b.list").alias("b"))


def overlap_pairs(records: DataFrame, ident: str, side: str, place: Column, tokens: str, value: str, within: float, extra: list[str] | None = None, share: float = 1.0) -> DataFrame:
    """All pairs of an evaluation and a training record with the same ``place``, token multisets of a Jaccard similarity of at least ``share`` (1: equal),
    and values less than ``within`` apart.

    ``side``: boolean column, true for evaluation. Records with a null place, tokens (or none of them) or value are in no pair; null tokens are left
    out. Returns (eval_id, train_id, and for each column x of ``extra`` eval_x and train_x), one row a pair of records; a repeated record gives its
    pairs again. An empty table gives none.

    Records with the same place and tokens form one class, however many they are. Classes meet by similar_sets, evaluation classes indexed and training
    classes probing; then evaluation records take on the training classes found for theirs, and meet training records of that class in cells of the
    value, four times ``within`` wide (an evaluation record lies in every cell that values nearer than ``within`` fall into, one or two; a pair
    meets in the training record's cell only). Class keys are 128 bits of hash of place and tokens. Hot classes are salted when evaluation records look up theirs; where
    both sides of a cell are large, their pairs are the result, and the adaptive skew join splits them.
    """
    extra = extra or []
    base = records.select(
        F.col(ident).alias("_id"), F.col(side).alias("_eval"), place.cast("string").alias("place"), numbered(F.filter(F.col(tokens), lambda t: t.isNotNull())).alias("set"), F.round(F.col(value).cast("double"), 9).alias("_v"), *[F.col(x).alias(f"_x_{x}") for x in extra]
    ).where(F.col("place").isNotNull() & (F.size("set") > 0) & F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_eval").isNotNull())
    # Values are rounded to a billionth: 1.25 - 1.1 must not fall below 0.15 by the last bit of its binary form.
    base = cut_lineage(base)
    classes = base.select("_eval", "place", "set").distinct()
    classes = cut_lineage(classes)
    found = similar_sets(classes.where("_eval").drop("_eval"), classes.where(~F.col("_eval")).drop("_eval"), share)

    def key(tokens: str) -> Column:
        text = F.concat_ws("\x1e", "place", F.concat_ws("\x1d", tokens))
        return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.reverse(text), F.lit("second")).alias("y"))

    links = found.select(key("a").alias("_class"), key("b").alias("_to"))
    keep = ["_id", "_v", *[f"_x_{x}" for x in extra]]
    wide = F.lit(4.0 * within)
    cells = F.sequence(F.floor((F.col("_v") - F.lit(within)) / wide), F.floor((F.col("_v") + F.lit(within)) / wide))
    evals = salted_join(base.where("_eval").select(key("set").alias("_class"), *keep), links, "_class", F.col("_id"))
    a = evals.select("_to", F.explode(cells).alias("_cell"), *keep).alias("a")
    b = base.where(~F.col("_eval")).select(key("set").alias("_to"), F.floor(F.col("_v") / wide).alias("_cell"), *keep).alias("b")
    near = F.round(F.abs(F.col("a._v") - F.col("b._v")), 9) < F.lit(within)
    pairs = a.join(b, (F.col("a._to") == F.col("b._to")) & (F.col("a._cell") == F.col("b._cell")) & near)
    return pairs.select(F.col("a._id").alias("eval_id"), F.col("b._id").alias("train_id"), *[F.col(f"a._x_{x}").alias(f"eval_{x}") for x in extra], *[F.col(f"b._x_{x}").alias(f"train_{x}") for x in extra])
