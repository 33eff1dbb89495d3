"""Problem 7: filling contexts of fixed capacity with texts, cutting none that fits.

The plan of what goes where is made on counts: there are at most `capacity` different piece sizes, so the table of
sizes and counts has at most `capacity` rows however large the corpus is. Sizes are routed to tiers, each with a context
size of its own (the capacity, its half, its quarter, ...). From the longest tier down, each piece of a tier opens a
window of the tier's context size, and the gap is filled from what is left of its own and the shorter tiers, the longest
piece that fits first. Well filled windows of a short tier are joined to containers of the capacity (2 halves, 4 quarters,
...); badly filled ones are taken apart, and their pieces go into the gaps that are left, or new containers, by best
fit. Containers with the same content are one pattern with a multiplicity. Pieces then find their container by their
rank among the pieces of their size, which is counted per salt so that no size is sorted in one task. Containers are
numbered so that each group of `step` containers gets an even share of fuller and emptier, longer and shorter content.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions.runtime import stage, table
from noteflow.llm.tokens import count_tokens

CAPACITY = 1800
#: Containers that one training step takes together.
STEP = 64
#: Tiers: context sizes of the capacity, half of it, a quarter and so on.
TIERS = 4
#: The share of a short window that may stay empty; emptier windows are taken apart.
SLACK = 0.01
#: The table of slots is broadcast up to this many rows.
SLOT_ROWS = 500_000
#: Rows that one task ranks at most, about.
RANK_ROWS = 250_000


def tiers_of(capacity: int, tiers: int = TIERS) -> list[int]:
    """Context sizes of the tiers, longest first: parts of the capacity by powers of two, so that whole windows of a tier
    fill a container."""
    return [capacity >> k for k in range(tiers) if capacity >> k]


Pattern = tuple[int, ...]


def _windows(left: dict[int, int], high: int, low: int) -> list[tuple[Pattern, int, int]]:
    """(pattern, room, windows): pieces of a size in (low, high] open windows of `high`, the longest first; gaps take the
    longest pieces left that fit. What is used is taken from `left`."""
    sizes = sorted(s for s, n in left.items() if n)
    todo: list[tuple[Pattern, int, int]] = []
    out: dict[tuple[Pattern, int], int] = {}

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            sizes.pop(bisect_left(sizes, size))

    while True:
        if not todo:
            at = bisect_right(sizes, high) - 1
            if at < 0 or sizes[at] <= low:
                break
            size, n = sizes[at], left[sizes[at]]
            take(size, n)
            full, rest = divmod(n, high // size)
            todo += [((size,) * rest, high - rest * size, 1)] if rest else []
            todo += [((size,) * (high // size), high % size, full)] if full else []
        pattern, room, n = todo.pop()
        at = bisect_right(sizes, room) - 1
        if at < 0 or n == 0:
            out[(pattern, room)] = out.get((pattern, room), 0) + n
            continue
        size = sizes[at]
        fit = min(room // size, max(1, left[size] // n))
        some = min(n, left[size] // fit)
        take(size, some * fit)
        todo.append((pattern + (size,) * fit, room - fit * size, some))
        if some < n:
            todo.append((pattern, room, n - some))
    return [(p, r, n) for (p, r), n in out.items() if n]


def _join_windows(windows: list[tuple[Pattern, int, int]], group: int) -> tuple[list[tuple[Pattern, int, int]], list[tuple[Pattern, int, int]]]:
    """Containers of `group` windows each, equal ones first, and the windows left over."""
    out, open_ = [], []
    for pattern, room, n in windows:
        while open_ and n:
            open_.append((pattern, room, 1))
            n -= 1
            if len(open_) == group:
                out.append((sum((p for p, _, _ in open_), ()), sum(r for _, r, _ in open_), 1))
                open_ = []
        whole, rest = divmod(n, group)
        if whole:
            out.append((pattern * group, room * group, whole))
        open_ += [(pattern, room, 1)] * rest
    return out, open_


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, tiers: int = TIERS, slack: float = SLACK) -> list[tuple[Pattern, int]]:
    """Patterns (sizes in a container, longest first) with the number of containers each, for counts {size: pieces}.

    Works on sizes, not pieces: a step gives one piece of a size to all containers of a pattern at once, so the time
    depends on the capacity and hardly on the counts. Another number of tiers gives other patterns.
    """
    left = {s: n for s, n in counts.items() if n}
    bounds = tiers_of(capacity, tiers)
    opened: list[tuple[Pattern, int, int]] = []
    apart: dict[int, int] = {}
    for t, high in enumerate(bounds):
        made = _windows(left, high, bounds[t + 1] if t + 1 < len(bounds) else 0)
        if t == 0:
            opened += made
            continue
        group = capacity // high
        good = sorted((w for w in made if w[1] <= slack * high), key=lambda w: (w[1], w[0]))
        full, rest = _join_windows(good, group)
        opened += [(p, capacity - sum(p), n) for p, _, n in full]
        for pattern, _, n in rest + [w for w in made if w[1] > slack * high]:
            for size in pattern:
                apart[size] = apart.get(size, 0) + n
    return _best_fit(apart, opened, capacity)


def _best_fit(counts: dict[int, int], opened: list[tuple[Pattern, int, int]], capacity: int) -> list[tuple[Pattern, int]]:
    """The pieces of `counts`, longest first, each in the fullest container that holds it; `opened` has containers with
    room left."""
    open_: dict[int, dict[Pattern, int]] = {}  # room left: {pattern: containers}
    rooms: list[int] = []
    done: dict[Pattern, int] = {}

    def put(pattern: Pattern, room: int, n: int) -> None:
        if room == 0:
            done[pattern] = done.get(pattern, 0) + n
            return
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for pattern, room, n in opened:
        put(pattern, room, n)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                fit = capacity // size
                full, rest = divmod(left, fit)
                if full:
                    put((size,) * fit, capacity - fit * size, full)
                if rest:
                    put((size,) * rest, capacity - rest * size, 1)
                break
            room = rooms[at]
            pattern, n = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fit = room // size
            # as many of this size as the gap takes, in as many containers as there are pieces for
            whole = min(n, left // fit)
            if whole:
                put(pattern + (size,) * fit, room - fit * size, whole)
                left -= whole * fit
            if whole < n and left:
                put(pattern + (size,) * left, room - left * size, 1)
                left = 0
                whole += 1
            if whole < n:
                put(pattern, room, n - whole)
    for room in open_.values():
        for pattern, n in room.items():
            done[pattern] = done.get(pattern, 0) + n
    merged: dict[Pattern, int] = {}
    for pattern, n in done.items():
        key = tuple(sorted(pattern, reverse=True))
        merged[key] = merged.get(key, 0) + n
    return sorted(merged.items(), key=lambda x: (-sum(x[0]), x[0]))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(size, first rank, ranks, first container): pieces of a size with ranks from `first rank` on fill the containers
    of a pattern in turn."""
    nexts: dict[int, int] = {}
    out, base = [], 0
    for pattern, n in patterns:
        for size in pattern:
            first = nexts.get(size, 0)
            out.append((size, first, n, base))
            nexts[size] = first + n
        base += n
    return out


def cut_to_capacity(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece, tokens: items within the capacity whole (piece 0), larger ones as full pieces and a rest."""
    whole = F.floor((F.col(size) - 1) / capacity).cast("int")
    return (
        sizes.where(F.col(size) > 0)
        .select(F.col(key), F.col(size).alias("__size"), F.posexplode(F.array_repeat(F.lit(0), whole + 1)).alias("piece", "__z"))
        .select(key, "piece", F.least(F.lit(capacity), F.col("__size") - F.col("piece") * capacity).cast("int").alias("tokens"))
    )


def pack_items(
    sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, step: int = STEP, tiers: int = TIERS
) -> DataFrame:
    """container_no bigint (from 0), key, piece_no int (from 0), n_tokens int: every item in containers of `capacity`.

    `sizes` should be a scan or a staged table, it is read three times. Items of a null, zero or negative size stay
    out; an item is cut only if it alone exceeds the capacity, into full pieces and a rest that is packed like any
    other piece. Repeated rows are items of their own; ties are broken by the key, so the result depends only on the
    rows (rows equal in key and size are interchangeable). An empty table gives no rows.
    """
    spark = sizes.sparkSession
    pieces = cut_to_capacity(sizes.select(key, size), key, size, capacity)
    counts = {r[0]: r[1] for r in pieces.groupBy("tokens").count().collect()}  # at most `capacity` rows
    patterns = pack_counts(counts, capacity, tiers)
    containers = sum(n for _, n in patterns)
    salts = max(1, sum(counts.values()) // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    # at most capacity * salts rows: where each salt's ranks begin
    begins = (
        salted.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("begin", F.sum("n").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("n")).drop("n")
    )
    ranked = (
        salted.withColumn("r", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy(key, "piece")) - 1)
        .join(begins, ["tokens", "salt"])
        .withColumn("r", F.col("r") + F.col("begin"))
    )
    table_ = _slots(patterns)
    slots = spark.createDataFrame(table_, "slot_tokens int, slot_rank bigint, slot_n bigint, slot_base bigint")
    placed = ranked.join(
        F.broadcast(slots) if len(table_) <= SLOT_ROWS else slots,
        (F.col("tokens") == F.col("slot_tokens")) & (F.col("r") >= F.col("slot_rank")) & (F.col("r") < F.col("slot_rank") + F.col("slot_n")),
    )
    number = F.col("slot_base") + F.col("r") - F.col("slot_rank")
    # deal the containers, sorted by content, over the steps like cards
    steps = max(1, -(-containers // step))
    if steps > 1:
        lap, seat = F.floor(number / steps), number % steps
        rows = containers // steps
        more = containers % steps  # steps 0 .. more-1 hold one container more
        begin = seat * rows + F.least(seat, F.lit(more))
        number = begin + lap
    return placed.select(
        number.cast("bigint").alias("container_no"), F.col(key), F.col("piece").alias("piece_no"), F.col("tokens").alias("n_tokens")
    )


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in contexts of CAPACITY tokens."""
    sizes = stage(count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    return pack_items(sizes)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the unused share."""
    packed = p7_packed(spark, sf_dir)
    return packed.agg(
        F.count_distinct("container_no").alias("containers"), F.sum("n_tokens").alias("tokens")
    ).select(
        "containers", "tokens", F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"),
        F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("unused"),
    )


def tier_fill(packed: DataFrame, capacity: int = CAPACITY, tiers: int = TIERS) -> DataFrame:
    """tier_tokens, containers, pieces, tokens, unused: the containers by the tier of their longest piece, and the share
    of their room that stays empty."""
    bounds = tiers_of(capacity, tiers)
    own = packed.groupBy("container_no").agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    tier = F.coalesce(*[F.when(F.col("longest") > low, F.lit(high)) for high, low in zip(bounds, [*bounds[1:], 0], strict=True)])
    return own.groupBy(tier.alias("tier_tokens")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.round(1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("unused"),
    )


def p7_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each tier are."""
    return tier_fill(p7_packed(spark, sf_dir))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill, "p7_tiers": p7_tiers}
SQL: dict[str, str] = {}
