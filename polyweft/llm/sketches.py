"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in Spark expressions only.

A text is the set of its paragraphs, a paragraph its XXH64. Paragraphs are lines; a line longer than ``LONGEST``
code points counts as pieces of that length, lest a text of one line be one cell. A table has three rows of
``WIDTH`` cells; a digest stands in one cell of each row, and a cell keeps the number, the exclusive or of the
digests and that of their checks. The table of one version minus that of another holds the differing digests
alone; cells with one of them give it away, and taking it out of its other cells uncovers more, until nothing is left.

A fingerprint is a list of such tables, the leaves of a binary tree: a leaf of level l stands for the digests with
its l low bits. Tables add up, so leaves give the tables of every coarser level. The number of paragraphs sets the
level a fingerprint starts from; leaves that would not give back their own digests are split, so a stored
fingerprint can always be read. Two fingerprints are compared by subtraction alone: at a level that suits both
numbers, each part's tables are summed and subtracted and the difference peeled; where that fails it is retried
larger, with twice the cells, from the finer leaves, or, where a side has none, from the digests its leaf gives back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 200
WIDTH, ROWS, CHECK_SEED = 5, 3, 17
CELLS = WIDTH * ROWS
#: Digests that a leaf should hold at most in the mean, differing ones that a first subtraction should; rounds of peeling.
LOAD, FIRST_LOAD, ROUNDS = 4, 8, 16
#: The last level; digests have 64 bits.
MOST = 63

_CHECK = f"xxhash64({{0}}, {CHECK_SEED})"
# the cells of a digest as set bits: one in each row, from three parts of its check
_MASK = "shiftleft(1, cast(pmod({0}, %d) as int)) | shiftleft(1, cast(pmod(shiftright({0}, 20), %d) as int) + %d) | shiftleft(1, cast(pmod(shiftright({0}, 40), %d) as int) + %d)" % (WIDTH, WIDTH, WIDTH, WIDTH, 2 * WIDTH)
_ZERO = "named_struct('n', 0, 'k', 0L, 'h', 0L)"
_LEAF = "struct<l:int,p:bigint,c:array<struct<n:int,k:bigint,h:bigint>>>"


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text; empty lines have none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{LONGEST}}})")), lambda p: F.xxhash64(p)))


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under a name: an array of one gives it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entries(digests_: str, sign: str) -> str:
    """Signed digests with their checks and cells."""
    with_check = f"transform({digests_}, d -> named_struct('d', d, 'h', {_CHECK.format('d')}))"
    return f"transform({with_check}, x -> named_struct('d', x.d, 'h', x.h, 'n', {sign}, 'm', {_MASK.format('x.h')}))"


def _plus(entries: str, cell: str, start: str) -> str:
    """A cell's value with the entries that stand in it."""
    return f"aggregate(filter({entries}, x -> getbit(x.m, {cell}) = 1), {start}, (a, x) -> named_struct('n', a.n + x.n, 'k', a.k ^ x.d, 'h', a.h ^ x.h))"


def _cells(entries: str) -> str:
    return f"transform(sequence(0, {CELLS - 1}), c -> {_plus(entries, 'c', _ZERO)})"


def _given_back(entries: str) -> str:
    """Whether a table of these entries peels: as sets of cells, those with a cell of their own go, round by round."""
    own = "aggregate(s, named_struct('o', 0, 't', 0), (a, m) -> named_struct('o', a.o | m, 't', a.t | (a.o & m)), a -> a.o & ~a.t)"
    rounds = f"aggregate(sequence(1, {CELLS}), transform({entries}, x -> x.m), (s, r) -> if(size(s) = 0, s, {_bound(own, 'o', 'filter(s, m -> (m & o) = 0)')}), s -> size(s) = 0)"
    return f"if(size({entries}) > {CELLS}, false, {rounds})"


def _peeled(cells: str) -> str:
    """(gone, ok): the signed digests that peeling finds; ok if no cell is left."""
    pure = f"array_distinct(transform(filter(s.rest, c -> abs(c.n) = 1 and {_CHECK.format('c.k')} = c.h), c -> named_struct('d', c.k, 'h', c.h, 'n', c.n, 'm', {_MASK.format('c.h')})))"
    out = "transform(s.rest, (c, i) -> aggregate(filter(p, x -> getbit(x.m, i) = 1), c, (a, x) -> named_struct('n', a.n - x.n, 'k', a.k ^ x.d, 'h', a.h ^ x.h)))"
    step = _bound(pure, "p", f"if(size(p) = 0, named_struct('rest', s.rest, 'gone', s.gone, 'stop', true), named_struct('rest', {out}, 'gone', concat(s.gone, p), 'stop', false))")
    none = _entries("cast(array() as array<bigint>)", "1")
    start = f"named_struct('rest', {cells}, 'gone', {none}, 'stop', false)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.stop, s, {step}), s -> named_struct('gone', s.gone, 'ok', forall(s.rest, c -> c.n = 0 and c.k = 0 and c.h = 0)))"


def _level(number: str, load: int) -> str:
    return f"cast(greatest(0, ceil(log2(greatest(1, {number}) / {load}))) as int)"


def _low(digest: str, level: str) -> str:
    return f"({digest} & (shiftleft(1L, {level}) - 1))"


def table(digests_: str) -> Column:
    """(n, leaves) of a column of distinct digests: their number and the leaves (level l, low bits p, cells c), in an order that the set sets."""
    halves = lambda groups: f"filter(flatten(transform({groups}, g -> array(filter(g, x -> getbit(x.d, k) = 0), filter(g, x -> getbit(x.d, k) = 1)))), g -> size(g) > 0)"
    level = _level(f"size({digests_})", LOAD)
    every = f"filter(array({_entries(digests_, '1')}), g -> size(g) > 0)"
    parts = f"if({level} = 0, {every}, aggregate(sequence(0, {level} - 1), {every}, (gs, k) -> {halves('gs')}))"
    tried = f"transform(s.open, g -> named_struct('g', g, 'ok', {_given_back('g')}))"
    leaf = f"named_struct('l', k, 'p', {_low('element_at(t.g, 1).d', 'k')}, 'c', {_cells('t.g')})"
    step = _bound(tried, "ts", f"named_struct('open', {halves('transform(filter(ts, t -> not t.ok), t -> t.g)')}, 'done', concat(s.done, transform(filter(ts, t -> t.ok), t -> {leaf})))")
    state = f"named_struct('open', {parts}, 'done', cast(array() as array<{_LEAF}>))"
    return F.expr(f"named_struct('n', size({digests_}), 'leaves', aggregate(sequence({level}, {MOST}), {state}, (s, k) -> if(size(s.open) = 0, s, {step}), s -> s.done))")


def difference(a: str, b: str) -> Column:
    """Digests that only one of two ``table`` columns holds: (d, n) with n 1 for the first and -1 for the second; from the tables alone."""
    signed = lambda t, n: f"transform({t}.leaves, x -> named_struct('l', x.l, 'p', x.p, 'c', x.c, 'n', {n}))"
    first = _level(f"({a}.n + {b}.n)", FIRST_LOAD)
    # digests that leaves give back, with the leaf's sign
    read = lambda leaves: f"flatten(transform({leaves}, y -> transform({_peeled('y.c')}.gone, x -> named_struct('d', x.d, 'h', x.h, 'n', y.n, 'm', x.m))))"
    finer = lambda g, level: f"named_struct('ls', filter({g}.ls, y -> y.l >= {level}), 'es', concat({g}.es, {read(f'filter({g}.ls, y -> y.l < {level})')}))"
    half = lambda bit: f"named_struct('ls', filter(g.ls, y -> getbit(y.p, k) = {bit}), 'es', filter(g.es, x -> getbit(x.d, k) = {bit}))"
    halves = lambda groups: f"filter(flatten(transform({groups}, g -> array({half(0)}, {half(1)}))), g -> size(g.ls) + size(g.es) > 0)"
    none = _entries("cast(array() as array<bigint>)", "1")
    every = _bound(f"named_struct('ls', concat({signed(a, '1')}, {signed(b, '-1')}), 'es', {none})", "w", f"array({finer('w', first)})")
    groups = f"if({first} = 0, {every}, aggregate(sequence(0, {first} - 1), {every}, (gs, k) -> {halves('gs')}))"
    summed = "aggregate(g.ls, named_struct('n', 0, 'k', 0L, 'h', 0L), (a, y) -> named_struct('n', a.n + y.n * element_at(y.c, c + 1).n, 'k', a.k ^ element_at(y.c, c + 1).k, 'h', a.h ^ element_at(y.c, c + 1).h))"
    cells = f"transform(sequence(0, {CELLS - 1}), c -> {_plus('g.es', 'c', summed)})"
    tried = f"transform(s.left, g -> named_struct('g', g, 'r', {_peeled(cells)}))"
    larger = f"transform(filter(ts, t -> not t.r.ok), t -> {finer('t.g', 'k + 1')})"
    step = _bound(tried, "ts", f"named_struct('left', {halves(larger)}, 'gone', concat(s.gone, flatten(transform(filter(ts, t -> t.r.ok), t -> t.r.gone))))")
    state = f"named_struct('left', {groups}, 'gone', {none})"
    return F.expr(f"transform(aggregate(sequence({first}, {MOST}), {state}, (s, k) -> if(size(s.left) = 0, s, {step}), s -> s.gone), x -> named_struct('d', x.d, 'n', x.n))")


def likeness(a: str, b: str) -> Column:
    """Shared by all paragraphs of two ``table`` columns; two without any are alike."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    # the difference stands in the expression once: Spark computes it anew at each place of a branch
    share = lambda differing: F.when(both == 0, 1.0).otherwise((both - differing) / F.greatest(both + differing, F.lit(1)))
    return F.element_at(F.transform(F.array(F.size(difference(a, b))), share), 1)


def as_text(column: str) -> Column:
    """A table as a string: number of paragraphs, then leaves as level:bits:cells; a cell that is not empty is its place, number, digest and check in hex."""
    cell = "if(x.n = 0, '', concat(hex(i), hex(x.n), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 16, '0')))"
    leaf = f"concat(';', hex(y.l), ':', hex(y.p), ':', array_join(transform(y.c, (x, i) -> {cell}), ''))"
    return F.expr(f"lower(concat(hex({column}.n), array_join(transform({column}.leaves, y -> {leaf}), '')))")


def from_text(column: str) -> Column:
    """The table that ``as_text`` told."""
    number = lambda x, base=10: f"cast(conv({x}, 16, {base}) as bigint)"
    cells = "regexp_extract_all(element_at(f, 3), '[0-9a-e][0-9a-f]{33}', 0)"
    cell = f"named_struct('n', cast({number('substr(x, 2, 1)')} as int), 'k', {number('substr(x, 3, 16)', -10)}, 'h', {number('substr(x, 19, 16)', -10)})"
    at = f"coalesce(element_at(transform(filter(cs, x -> {number('substr(x, 1, 1)')} = i), x -> {cell}), 1), {_ZERO})".replace("element_at(transform", "try_element_at(transform")
    leaf = f"named_struct('l', cast({number('element_at(f, 1)')} as int), 'p', {number('element_at(f, 2)', -10)}, 'c', {_bound(cells, 'cs', f'transform(sequence(0, {CELLS - 1}), i -> {at})')})"
    leaves = f"transform(transform(filter(split({column}, ';'), (x, i) -> i > 0), y -> split(y, ':')), f -> {leaf})"
    return F.expr(f"named_struct('n', cast({number(f"substring_index({column}, ';', 1)")} as int), 'leaves', {leaves})")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, own, next_text, next_own): each text and its table with those of the next row by id, after the last the first.

    Rows are dealt by ranges of ids, whose bounds come from a sketch of quantiles, and each range is a window of
    its own; a range's last row gets the first row of the range after it. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coarse = max(2, int((4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) ** 0.5))
    points = [i / coarse**2 for i in range(1, coarse**2)]
    bounds = rows.agg(F.percentile_approx("doc_id", points, 10 * coarse**2)).first()[0] or []  # a number that shuffle partitions set
    bounds = sorted(set(bounds))
    fine = F.array(*[F.lit(b) for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    tops = F.array(*[F.lit(b) for b in bounds[coarse - 1 :: coarse]]) if len(bounds) >= coarse else F.expr("cast(array() as array<bigint>)")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below(tops) * coarse + below(F.slice(fine, below(tops) * coarse + 1, coarse)))
    dealt = rows.withColumn("part", part)
    # one small row for each range, a number that shuffle partitions set: it is sent to the rows, which stay where they are
    mins = dealt.groupBy("part").agg(F.min("doc_id").alias("least"))
    first = F.broadcast(mins.select(F.col("part").alias("p"), "least"))
    firsts = dealt.join(first, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").groupBy("part").agg(F.min("text").alias("text"))
    parts = Window.orderBy("part")
    after = mins.select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follows"))
    heads = after.join(firsts.withColumnRenamed("part", "follows"), "follows").withColumn("ds", digests(F.col("text"))).select(F.col("part").alias("p"), F.col("text").alias("head"), table("ds").alias("head_own"))
    # tables are made after the shuffle, which carries texts alone
    made = dealt.repartition("part").withColumn("ds", digests(F.col("text"))).withColumn("own", table("ds")).drop("ds")
    w = Window.partitionBy("part").orderBy("doc_id", "text")
    led = made.withColumns({"inside": F.lead("text").over(w), "inside_own": F.lead("own").over(w)})
    return led.join(F.broadcast(heads), F.col("part") == F.col("p")).select("doc_id", "text", "own", F.coalesce("inside", "head").alias("next_text"), F.when(F.col("inside").isNull(), F.col("head_own")).otherwise(F.col("inside_own")).alias("next_own"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the tables (own, changed) of every row.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next row,
    by id, nulls first, rows that repeat an id by text; after the last comes the first, and a single row is its own
    next. Null texts are empty. Repeated paragraphs count once. Ids are whole numbers (others raise). An empty
    table gives no rows. ``near_*`` are functions of two fingerprints: ``likeness`` of their ``from_text`` says the same.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    made = rows.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("ds"), "own", "next_own")
    both = made.withColumn("changed", table("ds"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"), "own", "changed",
    )
