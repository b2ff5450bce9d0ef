"""Selections in which every pick changes the score of the next: per group in parallel, or over summaries on the driver."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from evalloom.operators.windows import fair_targets, quotas, top_k
from evalloom.session import ship_package

#: Most candidate summaries (one short row each) a driver-side selection holds at a time.
MOST_SUMMARIES = 100_000


def map_groups(df: DataFrame, group: str, columns: list[str], best: Column, pick: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Rows (group, ident, position) that ``pick`` returns for the rows (group, *columns) of each group; ident is the first of the columns.
    The rows come by falling ``best`` (null and NaN last), then ident.

    One shuffle and sort by Spark; a task then runs through its groups in Arrow batches, holding one group at a time, so many
    small groups cost no call each. A group must fit a task. Rows with a null group are left out.
    """
    ship_package(df.sparkSession)
    score = best.cast("double")
    slim = df.where(F.col(group).isNotNull()).select(group, *columns, F.when(~F.isnan(score), score).alias("_best"))
    names = [group, *columns]
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    outputs = [group, columns[0], "position"]
    schema = f"`{group}` {kinds[group]}, `{columns[0]}` {kinds[columns[0]]}, position int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*[pdf[c].tolist() for c in names], strict=True):
                if held and row[0] != held[0][0]:
                    out += pick(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=outputs)
        if held:
            yield pd.DataFrame(pick(held), columns=outputs)

    return slim.repartition(group).sortWithinPartitions(group, F.desc_nulls_last("_best"), columns[0]).mapInPandas(run, schema)


def clips_of_group(df: DataFrame, group: str, ident: str, features: list[str], quality: str, k: int) -> DataFrame:
    """(group, ident, position): per group, ``k`` rows, each the one with the fewest already picked equals in the features, then the best
    quality, then ident. For groups that fit a task (a group's clips); groups run in parallel."""

    def pick(rows: list[tuple]) -> list[tuple]:
        seen: Counter = Counter()
        rows, out = list(rows), []
        while rows and len(out) < k:
            best = min(range(len(rows)), key=lambda i: (sum(seen[f, v] for f, v in enumerate(rows[i][2:])), i))
            row = rows.pop(best)
            seen.update(enumerate(row[2:]))
            out.append((row[0], row[1], len(out) + 1))
        return out

    return map_groups(df, group, [ident, *features], F.col(quality), pick)


def scene_three_passes(df: DataFrame, scene: str, ident: str, kinds: list[str], anchor: str, reuse: str, cap: int) -> DataFrame:
    """(scene, ident, position): per scene up to ``cap`` candidates: one of each kind, then new anchors, then the rest, best reuse first (null and NaN last), ties by ident.

    The first two rules are ranks within (scene, kind) and, of what they leave, within (scene, anchor), where only anchors count that no pick of the first rule has; of a hot
    scene each rule needs its first ``cap`` rows only, which is what is shuffled. Null scenes are left out.
    """
    score = F.col(reuse).cast("double")
    order = [F.desc_nulls_last("_best"), F.col(ident)]
    rows = df.where(F.col(scene).isNotNull()).select(scene, ident, *dict.fromkeys([*kinds, anchor]), F.when(~F.isnan(score), score).alias("_best"))
    names = [scene, ident, anchor, "_best"]
    firsts = top_k(rows, [scene, *kinds], order, 1, "_n").select(*names)
    one = top_k(firsts, [scene], order, cap, "_in_rule").withColumn("_rule", F.lit(0))
    # cap rows of each kind, of each anchor and of the scene hold all that the other rules can pick.
    rest = rows.select(*names).join(one.select(scene, ident), [scene, ident], "left_anti")
    seen = one.select(F.col(scene).alias("_s"), F.col(anchor).alias("_a")).distinct()
    fresh = top_k(rest, [scene, anchor], order, 1, "_n").select(*names).join(seen, (F.col(scene) == F.col("_s")) & F.col(anchor).eqNullSafe(F.col("_a")), "left_anti")
    two = top_k(fresh, [scene], order, cap, "_in_rule").withColumn("_rule", F.lit(1))
    last = top_k(rest, [scene], order, 2 * cap, "_in_rule").withColumn("_rule", F.lit(2))
    every = one.unionByName(two).unionByName(last).groupBy(scene, ident).agg(F.min(F.struct("_rule", "_in_rule")).alias("_r"))
    return top_k(every, [scene], ["_r._rule", "_r._in_rule", ident], cap).select(scene, ident, F.col("position").cast("int").alias("position"))


class Pool:
    """Candidates from which the best is taken again and again under a key that picks change, brought to the driver a piece at a time.

    ``key`` gives the key of a row (a tuple; None: closed for good) and may only grow with picks. So the ``most`` rows of the least keys are fetched, ties by the
    ident's text, and taken from as long as the best of them is no worse than the last of them was, which no row outside can be below. Then the next
    are fetched under the keys of that time, which ``spark_key`` gives as columns with the condition that a row is open. ``columns`` of a row, the ident first, are what ``key`` sees.
    """

    def __init__(self, candidates: DataFrame, columns: list[str], key: Callable[[tuple], tuple | None], spark_key: Callable[[], tuple[list[Column], Column]], most: int = MOST_SUMMARIES, taken: Counter | None = None):
        self.candidates, self.columns, self.key, self.spark_key, self.most = candidates, columns, key, spark_key, most
        self.taken = Counter() if taken is None else taken
        self.rows: list[tuple] = []
        self.heap: list[tuple] | None = None
        self.last: tuple | None = None

    def _fetch(self) -> None:
        tie = F.coalesce(F.col(self.columns[0]).cast("string"), F.lit("None"))
        size = self.most + sum(self.taken.values())
        order: list[str] = []
        found = self.candidates.select(*self.columns, tie.alias("_tie")).limit(size + 1).collect() if self.heap is None else None
        if found is None or len(found) > size:  # more than the driver holds: the first ones by key
            keys, is_open = self.spark_key()
            order = [f"_k{i}" for i in range(len(keys))]
            found = self.candidates.where(is_open).select(*self.columns, *[c.alias(n) for c, n in zip(keys, order, strict=True)], tie.alias("_tie")).orderBy(*order, "_tie").limit(size).collect()
        rows = [(tuple(tuple(v) if isinstance(v, list) else v for v in r[: len(self.columns)]), r["_tie"]) for r in found]
        self.last = (tuple(found[-1][n] for n in order), found[-1]["_tie"]) if order and len(rows) == size else None
        self.rows, self.heap, spare = [r for r, _ in rows], [], Counter(self.taken)
        for i, (row, text) in enumerate(rows):
            if spare[row]:
                spare[row] -= 1
            elif (now := self.key(row)) is not None:
                self.heap.append((now, text, i))
        heapq.heapify(self.heap)

    def next(self) -> tuple | None:
        """The best row now, which is thereby taken; None if all are taken or closed. The caller notes the pick in what ``key`` looks at."""
        if self.heap is None:
            self._fetch()
        while True:
            while self.heap:
                was, text, i = self.heap[0]
                now = self.key(self.rows[i])
                if now is None:
                    heapq.heappop(self.heap)
                elif now != was:
                    heapq.heapreplace(self.heap, (now, text, i))
                elif self.last is not None and (now, text) > self.last:
                    break
                else:
                    heapq.heappop(self.heap)
                    self.taken[self.rows[i]] += 1
                    return self.rows[i]
            if self.last is None:
                return None
            self._fetch()


def _is_in(c: str, values: set) -> Column:
    known = [v for v in values if v is not None]
    found = F.col(c).isin(known) if known else F.lit(False)
    return F.when(F.col(c).isNull(), F.lit(None in values)).otherwise(found)


class Tally:
    """Counts of the values of a column, or of the elements of an array column, among the picks. Null is a value; a null array has no elements."""

    def __init__(self, column: str, counts: Counter | None = None):
        self.column = column
        self.counts: Counter = Counter() if counts is None else counts

    def note(self, value) -> None:
        self.counts.update(value if isinstance(value, tuple) else [value])

    def of(self, value) -> int:
        return sum(self.counts[v] for v in value) if isinstance(value, tuple) else self.counts[value]

    def lookup(self, numbers: dict, c: Column, default: float = 0) -> Column:
        """A number for each value, as a column; ``default`` for values not listed."""
        null = F.lit(numbers.get(None, default))
        listed = [F.lit(x) for pair in numbers.items() if pair[0] is not None for x in pair]
        found = F.coalesce(F.try_element_at(F.create_map(*listed), c), F.lit(default)) if listed else F.lit(default)
        return F.when(c.isNull(), null).otherwise(found)

    def column_of(self, df: DataFrame, numbers: dict | None = None) -> Column:
        """What ``of`` gives, or the sum of ``numbers`` over the values, as a column."""
        numbers = dict(self.counts) if numbers is None else numbers
        if isinstance(df.schema[self.column].dataType, ArrayType):
            zero = F.lit(0).cast("double")
            return F.aggregate(F.coalesce(F.col(self.column), F.array().cast(df.schema[self.column].dataType)), zero, lambda a, x: a + self.lookup(numbers, x))
        return self.lookup(numbers, F.col(self.column)).cast("double")


@dataclass(frozen=True)
class Rule:
    """One part of a greedy key, less is better. count: picks with the row's value. fill: their share of the value's target (1 where it has none). full: whether the target
    is reached (it is at once where there is none); as long as others are not, values that have reached theirs come after them."""

    kind: str
    tally: Tally
    targets: dict | None = None

    def of(self, value) -> float:
        n = float(self.tally.of(value))
        if self.kind == "count":
            return n
        goal = self.targets.get(value, 0 if self.kind == "full" else 1)
        return n / max(1, goal) if self.kind == "fill" else float(n >= goal)

    def column(self, df: DataFrame) -> Column:
        counts = self.tally.counts
        if self.kind == "count":
            return self.tally.column_of(df)
        values = set(counts) | set(self.targets)
        if self.kind == "fill":
            return self.tally.column_of(df, {v: counts[v] / max(1, self.targets.get(v, 1)) for v in values})
        # 1 is the default: a value without a target is full.
        return F.lit(1.0) - self.tally.column_of(df, {v: 1.0 for v in self.targets if counts[v] < self.targets[v]})


def counted_greedy(candidates: DataFrame, ident: str, rules: list[Rule], ties: list[str], k: int, caps: dict[str, tuple[Tally, dict]] | None = None, notes: list[Tally] | None = None, most: int = MOST_SUMMARIES) -> list[tuple]:
    """Up to ``k`` rows (ident, position, key), each time the candidate whose rules give the least tuple; then the least of the columns ``ties`` (numbers), then the ident's text.

    Every pick is counted in the tallies of the rules, of the caps and of ``notes``, each tally once; tallies may be shared by several selections, which then take account of
    each other. ``caps``: {name: (tally, {value: most})}; a candidate with a value (or, for an array, any element) that has reached its cap is closed. All candidates count; see Pool
    for what is on the driver at a time. A null tie ranks last.
    """
    caps = caps or {}
    tallies = {id(t): t for t in [*[r.tally for r in rules], *[t for t, _ in caps.values()], *(notes or [])]}
    columns = [ident, *ties, *dict.fromkeys(t.column for t in tallies.values())]
    at = {c: i for i, c in enumerate(columns)}
    rows = candidates.select(*dict.fromkeys(columns)).persist()
    worst = float("inf")

    def key(row: tuple) -> tuple | None:
        for tally, limits in caps.values():
            value = row[at[tally.column]]
            for v in value if isinstance(value, tuple) else [value]:
                if v in limits and tally.counts[v] >= limits[v]:
                    return None
        return (*[r.of(row[at[r.tally.column]]) for r in rules], *[worst if row[at[t]] is None else float(row[at[t]]) for t in ties])

    def spark_key() -> tuple[list[Column], Column]:
        is_open = F.lit(True)
        for tally, limits in caps.values():
            shut = {v: 1.0 for v, m in limits.items() if tally.counts[v] >= m}
            is_open = is_open & (tally.column_of(rows, shut) == 0)
        return [*[r.column(rows) for r in rules], *[F.coalesce(F.col(t).cast("double"), F.lit(worst)) for t in ties]], is_open

    out: list[tuple] = []
    try:
        pool = Pool(rows, columns, key, spark_key, most)
        while len(out) < k and (row := pool.next()) is not None:
            out.append((row[0], len(out) + 1, key(row)))
            for t in tallies.values():
                t.note(row[at[t.column]])
    finally:
        rows.unpersist()
    return out


@dataclass(frozen=True)
class GroupColumns:
    """Names of the columns that a balanced selection of groups looks at; labels is an array."""

    ident: str
    family: str
    scene: str
    label: str
    labels: str
    room: str
    motion: str
    answer: str
    anchor: str
    dimension: str
    prior: str  # 0 for groups that an earlier plan has, 1 for others
    supply: str  # clips there are


def family_balanced(candidates: DataFrame, c: GroupColumns, family_targets: dict[str, int], label_caps: dict | None = None, scene_caps: dict | None = None, last_scenes: list | None = None, most: int = MOST_SUMMARIES) -> list[tuple]:
    """(ident, family, position) of groups that meet ``family_targets``: scenes, labels and rooms are used evenly over all families, and labels, dimensions, motions, answers
    and anchors within each. Hard caps on scenes and single labels hold throughout. Raises if a family cannot reach its target.

    The family with the fewest candidates for what it needs goes first, freely, ``last_scenes`` only when others are used up. In each other family motions get max-min fair
    targets and are picked from in turn, the smallest target first, while labels aim at fair targets of the family, and dimensions, if it has several, at even ones.
    """
    rows = candidates.select(*dict.fromkeys(vars(c).values())).withColumns({"_pair": F.to_json(F.struct(c.scene, c.label), {"ignoreNullFields": "false"}), "_less": -F.col(c.supply).cast("double")}).persist()
    scenes, labels, rooms, singles = Tally(c.scene), Tally(c.label), Tally(c.room), Tally(c.labels)
    caps = {"labels": (singles, label_caps or {}), "scenes": (scenes, scene_caps or {})}
    count = lambda df, column: {r[0]: r[1] for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1))).collect()}
    out: list[tuple] = []
    try:
        there = count(rows, c.family)
        order = sorted(family_targets, key=lambda f: (there.get(f, 0) / max(1, family_targets[f]), f))
        for family in order:
            of_family = rows.where(F.col(c.family) == family)
            own = {name: Tally(getattr(c, name)) for name in ("scene", "label", "motion", "dimension", "answer", "room")}

            def pick(df: DataFrame, k: int, goals: list[Rule], fills: list[Rule], own: dict = own, family: str = family) -> int:
                anchors, pairs = Tally(c.anchor), Tally("_pair")
                counts = [labels, own["label"], own["motion"], own["answer"], rooms, own["room"], pairs, anchors]
                rules = [*goals, Rule("count", scenes), Rule("count", own["scene"]), *fills, *[Rule("count", t) for t in counts]]
                found = counted_greedy(df, c.ident, rules, [c.prior, "_less"], k, caps, [own["dimension"]], most)
                out.extend([(i, family, len(out) + n) for n, (i, _, _) in enumerate(found, 1)])
                return len(found)

            got, target = 0, family_targets[family]
            if family == order[0]:
                late = _is_in(c.scene, set(last_scenes or []))
                for part in (of_family.where(~late), of_family.where(late)):
                    got += pick(part, target - got, [], []) if got < target else 0
            else:
                aims = [(own["label"], fair_targets(count(of_family, c.label), target))]
                dims = sorted(count(of_family, c.dimension))
                if len(dims) > 1:
                    aims.append((own["dimension"], dict(zip(dims, quotas(target, len(dims)), strict=True))))
                motions = count(of_family, c.motion)
                shares = fair_targets(motions, target)
                for motion in sorted(shares, key=lambda m: (shares[m], motions[m], m)):
                    if shares[motion]:
                        got += pick(of_family.where(F.col(c.motion) == motion), shares[motion], [Rule("full", *a) for a in aims], [Rule("fill", *a) for a in aims])
            if got != target:
                raise ValueError(f"{family}: {got} groups found for a target of {target}")
    finally:
        rows.unpersist()
    return out


def pick_for_targets(candidates: DataFrame, ident: str, match: list[str], targets: list[tuple], label: str, scene: str, room: str, ties: list[str], most: int = MOST_SUMMARIES) -> list[tuple]:
    """(ident, position) with one candidate for each of ``targets``, in their order: of those not picked that equal it in the columns ``match`` (null equals null) the one whose
    labels (an array column), then scene, then room are used least so far; then the least of the columns ``ties``. Raises where none is left."""
    tallies = [Tally(label), Tally(scene), Tally(room)]
    rules = [Rule("count", t) for t in tallies]
    rows = candidates.select(*dict.fromkeys([ident, *match, label, scene, room, *ties])).persist()
    columns = list(dict.fromkeys([ident, label, scene, room, *ties]))
    at = {c: i for i, c in enumerate(columns)}
    worst = float("inf")
    pools: dict[tuple, Pool] = {}
    out: list[tuple] = []

    def key(row: tuple) -> tuple:
        return (*[r.of(row[at[r.tally.column]]) for r in rules], *[worst if row[at[t]] is None else float(row[at[t]]) for t in ties])

    try:
        for target in targets:
            if target not in pools:
                same = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.lit(v)) for m, v in zip(match, target, strict=True)])
                pools[target] = Pool(rows.where(same), columns, key, lambda: ([*[r.column(rows) for r in rules], *[F.coalesce(F.col(t).cast("double"), F.lit(worst)) for t in ties]], F.lit(True)), most)
            row = pools[target].next()
            if row is None:
                raise ValueError(f"no candidate for target {target}")
            out.append((row[0], len(out) + 1))
            for t in tallies:
                t.note(row[at[t.column]])
    finally:
        rows.unpersist()
    return out


def bucket_passes(candidates: DataFrame, ident: str, bucket: str, buckets: list, scene: str, label: str, per_bucket: int, scene_cap: int, label_cap: int, seed: int = 0) -> list[tuple]:
    """(ident, bucket, position): up to ``per_bucket`` candidates of each bucket, buckets in the order given, candidates in hash order; those whose scene or label has reached its cap
    are passed over. Buckets that are still short are gone through again without the scene cap, then without either.

    Only the first ``per_bucket`` candidates of a bucket, scene and label can be picked; they are what comes to the driver, one bucket at a time.
    """
    place = F.xxhash64(F.lit(seed), F.col(ident).cast("string"))
    first = top_k(candidates.where(F.col(bucket).isin(*buckets)).select(ident, bucket, scene, label, place.alias("_place")), [bucket, scene, label], ["_place", ident], per_bucket, "_n").drop("_n").persist()
    scenes: Counter = Counter()
    labels: Counter = Counter()
    done: Counter = Counter()
    used: set = set()
    out: list[tuple] = []
    try:
        for by_scene, by_label in ((True, True), (False, True), (False, False)):
            for b in buckets:
                if done[b] >= per_bucket:
                    continue
                for row in first.where(F.col(bucket) == F.lit(b)).orderBy("_place", ident).toLocalIterator():
                    if done[b] >= per_bucket:
                        break
                    if (b, row[ident]) in used or (by_scene and scenes[row[scene]] >= scene_cap) or (by_label and labels[row[label]] >= label_cap):
                        continue
                    used.add((b, row[ident]))
                    done[b] += 1
                    scenes[row[scene]] += 1
                    labels[row[label]] += 1
                    out.append((row[ident], b, len(out) + 1))
    finally:
        first.unpersist()
    return out


def balanced_under_caps(candidates: DataFrame, ident: str, scene: str, label: str, k: int, scene_cap: int, label_cap: int, most: int = MOST_SUMMARIES) -> list:
    """Up to ``k`` idents, each time the candidate of the least used label and scene. Caps hold first; then the scene cap is given up,
    then both, if candidates run out. Ties by ident. All candidates count; only the first ``k`` of a scene and label can be picked, and at
    most ``most`` rows besides the picks are on the driver at a time."""
    scenes, labels = Tally(scene), Tally(label)
    taken: Counter = Counter()
    out: list = []
    tie = F.coalesce(F.col(ident).cast("string"), F.lit("None"))
    rows = top_k(candidates.select(ident, scene, label), [scene, label], [tie], k, "_place").select(ident, scene, label).persist()
    try:
        for strict_scene, strict_label in ((True, True), (False, True), (False, False)):

            def key(row: tuple, by_scene: bool = strict_scene, by_label: bool = strict_label) -> tuple | None:
                closed = (by_scene and scenes.of(row[1]) >= scene_cap) or (by_label and labels.of(row[2]) >= label_cap)
                return None if closed else (labels.of(row[2]), scenes.of(row[1]))

            def spark_key(by_scene: bool = strict_scene, by_label: bool = strict_label) -> tuple[list[Column], Column]:
                of_label, of_scene = labels.column_of(rows), scenes.column_of(rows)
                return [of_label, of_scene], (F.lit(not by_scene) | (of_scene < scene_cap)) & (F.lit(not by_label) | (of_label < label_cap))

            pool = Pool(rows, [ident, scene, label], key, spark_key, most, taken)
            while len(out) < k and (row := pool.next()) is not None:
                scenes.note(row[1])
                labels.note(row[2])
                out.append(row[0])
    finally:
        rows.unpersist()
    return out


#: What a new scene, each new anchor and a new room weigh. Fixed values.
NOVELTY = {"scene": 1000, "anchor": 50, "room": 10}


def novelty_pick(candidates: DataFrame, ident: str, scene: str, anchors: str, room: str, k: int, most: int = MOST_SUMMARIES) -> list:
    """Up to ``k`` idents by novelty, weighed as NOVELTY says; ties by ident. All candidates count; at most ``most`` rows besides the picks are on the driver at a time."""
    scenes, known, rooms, out = set(), set(), set(), []
    kind = candidates.schema[anchors].dataType
    rows = candidates.select(ident, scene, anchors, room).persist()

    def key(row: tuple) -> tuple:
        return (-(NOVELTY["scene"] * (row[1] not in scenes) + NOVELTY["anchor"] * len(set(row[2] or ()) - known) + NOVELTY["room"] * (row[3] not in rooms)),)

    def spark_key() -> tuple[list[Column], Column]:
        new = F.size(F.array_except(F.coalesce(F.col(anchors), F.array().cast(kind)), F.array(*[F.lit(a) for a in known]).cast(kind)))
        parts = (F.lit(NOVELTY["scene"]) * (~_is_in(scene, scenes)).cast("int"), F.lit(NOVELTY["anchor"]) * new, F.lit(NOVELTY["room"]) * (~_is_in(room, rooms)).cast("int"))
        return [-(parts[0] + parts[1] + parts[2])], F.lit(True)

    try:
        pool = Pool(rows, [ident, scene, anchors, room], key, spark_key, most)
        while len(out) < k and (row := pool.next()) is not None:
            scenes.add(row[1])
            known.update(row[2] or ())
            rooms.add(row[3])
            out.append(row[0])
    finally:
        rows.unpersist()
    return out


def adaptive_targets(available: dict[str, int], total: int, floor: int = 0) -> dict[str, int]:
    """Targets by key for ``total``: an equal demand, no key above what it has, the shortfall handed round to keys with room in key order."""
    keys = sorted(available)
    if not keys:
        return {}
    want = {k: min(available[k], max(floor, total // len(keys))) for k in keys}
    left = total - sum(want.values())
    while left > 0 and any(want[k] < available[k] for k in keys):
        for k in keys:
            if left > 0 and want[k] < available[k]:
                want[k] += 1
                left -= 1
    return want


def relax_until(steps: list, select, enough) -> tuple:
    """Calls ``select(step)`` for each setting of a schedule until ``enough(result)`` holds or the result stops growing. Returns (result, step)."""
    last, used, size = None, None, -1
    for step in steps:
        result = select(step)
        if last is not None and len(result) <= size:
            break
        last, used, size = result, step, len(result)
        if enough(result):
            break
    return last, used


def longest_first_shards(sizes: dict[str, int], shards: int) -> dict[str, int]:
    """Shard of each key: the largest key to the shard with the least so far (the lower number on ties)."""
    load = [0] * shards
    out = {}
    for k in sorted(sizes, key=lambda k: (-sizes[k], k)):
        i = min(range(shards), key=lambda i: (load[i], i))
        out[k] = i
        load[i] += sizes[k]
    return out


def hash_distinct(df: DataFrame, group: str, ident: str, bits: str, quality: str, least: int, k: int) -> DataFrame:
    """(group, ident, position): per group up to ``k`` rows, best first, whose integer hashes differ from every picked one in at least ``least`` bits;
    if they run out, the best of the rest fill up. Rows without a hash are left out."""

    def pick(rows: list[tuple]) -> list[tuple]:
        picked: list[tuple] = []
        for r in rows:
            if len(picked) < k and all(((int(r[2]) ^ int(p[2])) & (2**64 - 1)).bit_count() >= least for p in picked):
                picked.append(r)
        ids = {p[1] for p in picked}
        picked += [r for r in rows if r[1] not in ids][: k - len(picked)]
        return [(r[0], r[1], i + 1) for i, r in enumerate(picked)]

    return map_groups(df.where(F.col(bits).isNotNull()), group, [ident, bits], F.col(quality), pick)
