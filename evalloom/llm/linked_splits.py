"""Splits that keep related records together: a persisted component table with merge pointers, extended by each run, and splits by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import BUCKETS, local_rows, salted_join, unit_hash
from evalloom.session import cut_lineage, forget, stored

MOST_ROUNDS = 60
#: Blocks of at least this share of the records to place are placed one by one, as many as its inverse at most.
LARGE_SHARE = 0.0005


def _jumped(tree: DataFrame) -> DataFrame:
    """(node, up) with every pointer led on until it points to a root; roots point to themselves. Takes and gives a stored table.

    Each round doubles the length of the jumps. Only parents that are no roots have to be looked up, and rows that share one are spread over salts, so a
    root above a third of all nodes makes no hot task.
    """
    while True:
        further = tree.where(F.col("node") != F.col("up")).select(F.col("node").alias("up"), F.col("up").alias("next"))
        led = salted_join(tree, further, "up", F.col("node"), how="left")
        led = stored(led.select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        forget(tree)
        tree = led
        if tree.where("moved").isEmpty():
            return tree


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its connected component. A stored table; see session.forget.

    Each round hooks every node to its smallest neighbour if that is smaller, jumps pointers until all point to roots, and contracts the
    edges to roots. Roots left over are local minima, so their number at least halves a round, and jumping halves the depth:
    few jobs even for long chains. Every state is a table written to the shared folder, deleted once the next one stands. Null ends, loops and
    repeated edges are dropped.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = stored(edges)
    table: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tree = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        tree = _jumped(stored(tree.select("node", F.least("node", "least").alias("up"))))
        moved = tree.where(F.col("node") != F.col("up"))
        if table is None:
            longer = stored(tree.select("node", F.col("up").alias("root")))
        else:
            # A root that still has edges is a node of this round's tree; nodes new to the table cannot occur, edges only join roots.
            on = moved.select(F.col("node").alias("root"), F.col("up").alias("_to"))
            longer = stored(salted_join(table, on, "root", F.col("node"), how="left").select("node", F.coalesce("_to", "root").alias("root")))
        ends = salted_join(edges, moved.select(F.col("node").alias("u"), F.col("up").alias("_a")), "u", F.col("v"), how="left")
        ends = salted_join(ends, moved.select(F.col("node").alias("v"), F.col("up").alias("_b")), "v", F.col("u"), how="left")
        ends = ends.select(F.coalesce("_a", "u").alias("a"), F.coalesce("_b", "v").alias("b")).where(F.col("a") != F.col("b"))
        fewer = stored(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        for old in (tree, table, edges):
            forget(old)
        table, edges = longer, fewer
    else:
        raise RuntimeError("components did not settle")
    return table if table is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked_blocks(links: DataFrame) -> DataFrame:
    """(record, block) for every record of ``links`` (record, hub): records that share a hub, directly or through others, share a block.

    ``block`` is the smallest record of it. A record whose hubs are all null stands alone. Null records are dropped; repeated rows change nothing.

    Each record is first put under one of its hubs (its primary, the smallest), which takes all records of a hot hub out of the graph:
    what remains is hubs that share records, and of those only hubs with two or more primaries make edges, each to the smallest of
    them, never all pairs.
    """
    # Repeats go on the map side, and no step gathers the rows of one record: neither copies nor a record of very many hubs make a hot task.
    return _clustered(cut_lineage(links.where(F.col("record").isNotNull()).select("record", "hub").distinct()))


def _clustered(rows: DataFrame) -> DataFrame:
    """linked_blocks of rows that are distinct and written already."""
    members = rows.select("record", F.coalesce(F.col("hub"), F.concat(F.lit("~"), "record")).alias("hub"))
    members = cut_lineage(members.join(members.groupBy("record").agg(F.min("hub").alias("primary")), "record"))
    pairs = members.select("primary", "hub").distinct()
    stars = pairs.groupBy("hub").agg(F.min("primary").alias("low"), F.max("primary").alias("high")).where(F.col("low") != F.col("high"))
    edges = pairs.join(stars.select("hub", "low"), "hub").select(F.col("primary").alias("u"), F.col("low").alias("v"))
    roots = components(edges)
    tops = members.select("record", "primary").distinct()
    named = salted_join(tops, roots.select(F.col("node").alias("primary"), "root"), "primary", F.col("record"), how="left")
    named = cut_lineage(named.select("record", F.coalesce("root", "primary").alias("_root")))
    forget(roots)
    firsts = named.groupBy("_root").agg(F.min("record").alias("block"))
    return salted_join(named, firsts, "_root", F.col("record")).select("record", "block")


class ComponentTable:
    """The components found so far, kept in a folder that all runs and executors share. No run clusters again what an earlier one has.

    Every run appends ``members`` (record, block), the block a record was put into when it came; ``hubs`` (hub, block), likewise; and ``placed``
    (block, size, split, status), of which the newest row of a block counts. ``merges`` (block, into) has a pointer for each block name that a later run gave up, led
    to its end by pointer jumping; each run writes it whole, as it only has the names given up. A run is valid once its marker is written, last of all;
    what a lost run left is written over by the next one.
    """

    PARTS = {"members": "record string, block string", "hubs": "hub string, block string", "merges": "block string, into string", "placed": "block string, size bigint, split string, status string"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def runs(self) -> int:
        """Number of valid runs."""
        n = 0
        while self._exists(f"runs/{n}/_SUCCESS"):
            n += 1
        return n

    def _part(self, name: str, runs: range) -> DataFrame:
        """The rows that the given runs wrote, with ``run``."""
        out = local_rows(self.spark, [], f"{self.PARTS[name]}, run int")
        for i in runs:
            if self._exists(f"{name}/{i}"):
                out = out.unionByName(self.spark.read.schema(self.PARTS[name]).parquet(f"{self.folder}/{name}/{i}").withColumn("run", F.lit(i)))
        return out

    def _write(self, name: str, run: int, df: DataFrame) -> DataFrame:
        columns = [c.split()[0] for c in self.PARTS[name].split(", ")]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/{run}")
        return self._part(name, range(run, run + 1)).drop("run")

    def _all(self, name: str) -> DataFrame:
        return self._part(name, range(self.runs()))

    def _merges(self) -> DataFrame:
        n = self.runs()
        return self._part("merges", range(max(0, n - 1), n)).select("block", "into")

    def _now(self, df: DataFrame, spread: Column) -> DataFrame:
        """``df`` with the present name in ``block``."""
        names = self._merges().select("block", F.col("into").alias("_now"))
        return salted_join(df, names, "block", spread, how="left").withColumn("block", F.coalesce("_now", "block")).drop("_now")

    def blocks(self) -> DataFrame:
        """(record, block): every record with its present block, which is named by its smallest record."""
        return self._now(self._all("members").select("record", "block"), F.col("record"))

    def splits(self) -> DataFrame:
        """(record, block, split, status) for every record: new (placed by the last run), kept, or quarantined; see extend."""
        old = F.col("run") < self.runs() - 1
        placed = self._placed().withColumn("status", F.when(old & (F.col("status") == "new"), "kept").otherwise(F.col("status")))
        return salted_join(self.blocks(), placed.select("block", "split", "status"), "block", F.col("record")).select("record", "block", "split", "status")

    def _placed(self) -> DataFrame:
        newest = self._all("placed").groupBy("block").agg(F.max_by(F.struct("size", "split", "status", "run"), "run").alias("_r")).select("block", "_r.*")
        return newest.join(self._merges().select("block"), "block", "left_anti")

    def extend(self, links: DataFrame, targets: dict[str, float] | None = None, quarantine: str | None = None, seed: int = 3) -> None:
        """Adds the records of ``links`` (record, hub), new ones and known ones that bring further hubs. Null records are dropped; a record whose hubs are all null stands alone.

        Only these links are clustered, together with one node for each block that they touch through a known hub or record. Blocks that come to hang
        together are merged by pointers to the one of the smallest name; if a new record is smaller still, the block takes its name.

        With ``targets`` ({split: share}) each new block is given a split, see fill_deficits: a block whose earlier splits are one keeps it (status kept); where several
        meet, or a split that is no target, all of it goes to ``quarantine`` (the split of the largest target if not given), status quarantined for good, so
        that users can leave it out of training and evaluation alike.
        """
        run = self.runs()
        rows = cut_lineage(links.where(F.col("record").isNotNull()).select("record", "hub").distinct())
        there, records = rows.where(F.col("hub").isNotNull()), rows.select("record").distinct()
        seen_hubs = None
        if run == 0:  # nothing is known yet
            added = found = self._write("members", run, _clustered(rows))
            became = local_rows(self.spark, [], "was string, block string")
        else:
            known = there.select("hub").distinct().join(self._all("hubs").select("hub", "block"), "hub")
            seen_hubs = known.select("hub")
            members = self._all("members").select("record", "block")
            seen = cut_lineage(records.join(members, "record").select("record", "block"))
            touched = salted_join(there, known, "hub", F.col("record")).select("record", "block").unionByName(seen).distinct()
            touched = cut_lineage(self._now(touched, F.col("record")).distinct())
            old = touched.select("block").distinct()
            # A known block is a hub, "!" and its name, and a record: its smallest, so that the smallest record of what it joins comes out right.
            tie = F.concat(F.lit("!"), "block").alias("hub")
            found = cut_lineage(linked_blocks(rows.unionByName(touched.select("record", tie)).unionByName(old.select(F.col("block").alias("record"), tie))))
            added = self._write("members", run, found.join(records, "record", "left_semi").join(seen, "record", "left_anti"))
            became = cut_lineage(old.select(F.col("block").alias("record")).join(found, "record").select(F.col("record").alias("was"), "block"))
        hubs = there.join(found, "record").groupBy("hub").agg(F.min("block").alias("block"))
        self._write("hubs", run, hubs if seen_hubs is None else hubs.join(seen_hubs, "hub", "left_anti"))
        if run:
            moved = became.where(F.col("was") != F.col("block")).select(F.col("was").alias("node"), F.col("block").alias("up"))
            tree = _jumped(stored(self._merges().select(F.col("block").alias("node"), F.col("into").alias("up")).unionByName(moved)))
            self._write("merges", run, tree.select(F.col("node").alias("block"), F.col("up").alias("into")))
            forget(tree)
        if targets is not None:
            self._write("placed", run, self._place(added, became, targets, quarantine, seed))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/runs/{run}")

    def _place(self, added: DataFrame, became: DataFrame, targets: dict[str, float], quarantine: str | None, seed: int) -> DataFrame:
        """Rows of ``placed`` for the blocks that this run made or changed."""
        total_target = sum(targets.values())
        if total_target <= 0 or any(x < 0 for x in targets.values()):
            raise ValueError("targets must be non-negative and not all zero")
        shares = {k: v / total_target for k, v in targets.items()}
        quarantine = quarantine or max(sorted(shares), key=lambda k: shares[k])
        before = self._placed().select(F.col("block").alias("was"), "size", "split", "status")
        parts = before.join(became, "was").select("block", "size", "split", (F.col("status") == "quarantined").alias("out"))
        parts = parts.unionByName(added.groupBy("block").agg(F.count(F.lit(1)).alias("size")).select("block", "size", F.lit(None).cast("string").alias("split"), F.lit(False).alias("out")))
        now = parts.groupBy("block").agg(F.sum("size").alias("size"), F.min("split").alias("lo"), F.max("split").alias("hi"), F.max("out").alias("out"))
        clean = (F.col("lo") == F.col("hi")) & F.col("lo").isin(*shares) & ~F.col("out")
        now = now.withColumn("status", F.when(F.col("lo").isNull(), "new").when(clean, "kept").otherwise("quarantined"))
        now = cut_lineage(now.withColumn("split", F.when(F.col("status") == "kept", F.col("lo")).when(F.col("status") == "quarantined", quarantine)).select("block", "size", "split", "status"))
        standing = before.join(became.select("was"), "was", "left_anti").select("split", "size").unionByName(now.where(F.col("split").isNotNull()).select("split", "size"))
        fixed = {r["split"]: r["n"] for r in standing.groupBy("split").agg(F.sum("size").alias("n")).collect()}  # one row a split
        fresh = now.where(F.col("status") == "new").select("block", "size")
        placed = fill_deficits(fresh, shares, fixed, seed).withColumn("status", F.lit("new"))
        return now.where(F.col("status") != "new").unionByName(placed)


def fill_deficits(fresh: DataFrame, shares: dict[str, float], fixed: dict[str, int], seed: int = 3) -> DataFrame:
    """(block, size, split) for the blocks of ``fresh`` (block, size): they fill what the records ``fixed`` in each split leave to its share (shares add up to 1).

    Blocks of at least LARGE_SHARE of the records of ``fresh``, of which there can be no more than its inverse, go one by one, largest first, each to the split that is
    then shortest of its target; the rest in hash order, cut where running sizes reach the deficits that remain. So each share is met to about
    LARGE_SHARE unless large blocks are in the way. An empty table gives none.
    """
    spark = fresh.sparkSession
    new = fresh.agg(F.sum("size")).head()[0] or 0
    total = new + sum(fixed.values())
    deficit = {k: shares[k] * total - fixed.get(k, 0) for k in sorted(shares)}
    large = fresh.where(F.col("size") >= LARGE_SHARE * new).orderBy(F.desc("size"), "block").collect()
    chosen = []
    for row in large:
        to = max(deficit, key=lambda k: deficit[k])
        deficit[to] -= row["size"]
        chosen.append((row["block"], row["size"], to))
    picked = local_rows(spark, chosen, "block string, size bigint, split string")
    small = fresh.where(F.col("size") < LARGE_SHARE * new)
    left = {k: max(0.0, v) for k, v in deficit.items()}
    room = sum(left.values())
    rest = new - sum(r["size"] for r in large)
    # Running sizes within ranges of the hash, added to the sums of the ranges before.
    small = small.withColumn("_h", unit_hash(F.col("block"), salt=f"split{seed}")).withColumn("_b", F.floor(F.col("_h") * BUCKETS).cast("int"))
    before = small.groupBy("_b").agg(F.sum("size").alias("_s"))
    before = before.withColumn("_before", F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).select("_b", "_before")  # BUCKETS rows
    run = Window.partitionBy("_b").orderBy("_h", "block").rowsBetween(Window.unboundedPreceding, 0)
    small = small.join(F.broadcast(before), "_b").withColumn("_mid", F.sum("size").over(run) - F.col("size") / 2 + F.col("_before"))
    edge, bounds = 0.0, []
    for k in sorted(left):
        edge += left[k] * rest / room if room else 0.0
        bounds.append((k, edge))
    choice = F.lit(max(sorted(shares), key=lambda k: shares[k]))
    for k, upto in reversed(bounds):
        choice = F.when(F.col("_mid") < upto, F.lit(k)).otherwise(choice)
    return small.select("block", "size", choice.alias("split")).unionByName(picked)


def shared_object_tags(ids: Column) -> Column:
    """The eight-digit hexadecimal tags that anchor ids end in, in lower case; ids with counters or coordinates have none."""
    tags = F.transform(ids, lambda x: F.lower(F.regexp_extract(F.trim(x), r"(?:^|[^0-9A-Za-z])([0-9A-Fa-f]{8})$", 1)))
    return F.filter(tags, lambda x: x != "")


def reissue_base(group_id: Column) -> Column:
    """The id up to its eight-digit number: that of the group a re-issued one was made from. The whole id where it has no such number."""
    base = F.regexp_extract(group_id, r"^(.*?_[0-9]{8})(?![0-9])", 1)
    return F.when(base != "", base).otherwise(group_id)
