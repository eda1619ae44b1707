"""Fuzzy line deduplication, with DataFrame functions only.

Lines are normalised (lower-cased, without the marks that end or wrap words, other marks and control characters taken as
spaces, one space between words) and get a 64-bit SimHash of all their words. Two different normalised lines are linked if their SimHashes differ in at most BITS
bits and their edit similarity (1 - Levenshtein distance / longer length) is at least SIMILARITY. The bits are cut into
five blocks; lines within three bits agree on two of them at least, so they meet under one of ten pairs of blocks. Of
more than MANY lines too many would share so few bits by chance: they are cut into six blocks and meet under one of
twenty triples. No link is missed by either. Lines that are as similar by edits but differ in more bits are not linked
(see README for how many).

Lines under one key are never expanded into all pairs: each is first compared with the nearest of its keys' pivots, their most repeated lines,
then only lines of different components are, against the component with most of the key, and two of several common keys
under the first of these. Lines that share a key of few lines, but are close to none of them, leave it before. Very
frequent keys are dealt over several tasks. Equal normalised lines are one node. The first occurrence of each connected group, by document id
and line number, stays; all others go.

Defined results. Lines end at a newline; blank lines always stay and count as no line. A line of nothing but punctuation
is normalised to itself, trimmed. A null text stays null. Rows that repeat both id and text are one occurrence: all of
them keep a line or none does. Null ids come after all others. Lines and texts may be of any length. An empty table
gives no rows. Other columns are ignored by report() and kept by deduplicate(), also if their names are those used here.
Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, fresh, settle, written

BITS = 3
#: Least edit similarity, as a share of whole numbers.
PERCENT = 90
#: First bit and width of the blocks, and how many of them a key has: for up to MANY lines, and for more.
FEW_KEYS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)), 2
MANY_KEYS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)), 3
MANY = 1 << 27
#: All blocks, and of every key (keys are numbered through) the bits of its blocks.
BLOCKS = FEW_KEYS[0] + MANY_KEYS[0]
KEYS = [tuple(x + at for x in t) for at, (blocks, together) in ((0, FEW_KEYS), (len(FEW_KEYS[0]), MANY_KEYS)) for t in combinations(range(len(blocks)), together)]
N_FEW = comb(len(FEW_KEYS[0]), FEW_KEYS[1])
#: A sketch of fixed size, of one line of SEEN, finds the most frequent keys; those of more lines are dealt over tasks, GROUP lines each.
SEEN, TRACKED, MOST_HOT, GROUP = 16, 10_000, 1000, 20_000
#: Runs of fewer lines under a key are searched for close ones where they are.
SMALL = 32
#: Keys are told apart by sorting about so many rows at a time.
BUCKET = 1000
#: Bit counts are summed three to a 64-bit number, LANE bits apart; each may reach 2 ** GUARD - 1.
LANE, GUARD = 22, 18
#: Words whose bits are counted before they are summed; one less than a power of two.
TOGETHER = 15
_ONES = 1 | 1 << LANE | 1 << 2 * LANE
_MOST_WORDS = (1 << GUARD) - 1
#: Bits of the table that says which lines' texts are needed; others pass by mistake at times and only cost time.
NEED_BITS = 22


#: Marks that end or wrap words are dropped; control characters and other ASCII, Latin-1 and general marks part words.
_DROPPED = "!\"'(),.:;?[]`{}\xA1\xAB\xB7\xBB\xBF\u2018\u2019\u201A\u201C\u201D\u201E\u2026\u2039\u203A\u3001\u3002"
_PARTING = "".join(c for a, b in ((0, 31), (33, 47), (58, 64), (91, 96), (123, 191), (0x2010, 0x2027), (0x2030, 0x205E), (0x3003, 0x3003)) for c in map(chr, range(a, b + 1)) if c not in _DROPPED and c not in "\xAA\xB5\xBA")
_BLANK = " \t\r\x0b\x0c"


def _plain(line: Column) -> Column:
    return F.trim(F.translate(F.lower(line), _PARTING + _DROPPED, " " * len(_PARTING)))


def _spaced(line: Column, plain: Column) -> Column:
    words = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)
    return F.when(plain != "", words).otherwise(F.btrim(line, F.lit(_BLANK)))


def normalised(line: Column) -> Column:
    return _spaced(line, _plain(line))


def key_of(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that differ in id or text."""
    return F.xxhash64(doc_id, text)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with this column, computed once a row: Catalyst copies a projected expression to wherever it is used, but not a generated one."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """copy (tells repeated rows apart), row, doc, line, norm, node (the hash of norm) of every line that isn't blank."""
    rows = once(docs.select(F.monotonically_increasing_id().alias("copy"), F.col(doc_id).alias("doc"), F.col(text).alias("text")), "row", key_of(F.col("doc"), F.col("text")))
    lines = rows.select("copy", "row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    lines = once(lines, "plain", _plain(F.col("raw")))
    lines = once(lines.select("copy", "row", "doc", "line", "raw", "plain"), "norm", _spaced(F.col("raw"), F.col("plain"))).where("norm <> ''")
    return once(lines.select("copy", "row", "doc", "line", "norm"), "node", F.xxhash64("norm"))


def _added(planes: list[Column]) -> tuple[Column, list[Column]]:
    """Numbers of 64 bits (an odd number of them) added bit by bit: the ones of each bit's sum, and what carries into the twos."""
    ones, carries = planes[0], []
    for a, b in zip(planes[1::2], planes[2::2]):
        either = a.bitwiseXOR(b)
        carries.append(a.bitwiseAND(b).bitwiseOR(ones.bitwiseAND(either)))
        ones = ones.bitwiseXOR(either)
    return ones, carries


def _planes(lines: DataFrame, words: str, by: list[str]) -> DataFrame:
    """by, some (a number of words), and p0 to p3 for every TOGETHER of the line's words: the binary digits of how many of them have each bit set in their hash."""
    at = lines.select(*by, words, F.explode(F.sequence(F.lit(0), F.size(words) - 1, F.lit(TOGETHER))).alias("at"))
    inside = lambda i: F.when(F.col("at") + i < F.size(words), F.xxhash64(F.get(words, F.col("at") + i))).otherwise(F.lit(0).cast("bigint"))
    some = F.least(F.lit(TOGETHER), F.size(words) - F.col("at")).alias("some")
    out = once(at, "h", F.struct(*(inside(i).alias(f"h{i}") for i in range(TOGETHER)))).select(*by, some, "h")
    planes, held = [], [F.col(f"h.h{i}") for i in range(TOGETHER)]
    while len(held) > 1:
        ones, carries = _added(held)
        level = f"x{len(planes)}"
        out = once(out, level, F.struct(ones.alias("p"), *(c.alias(f"c{i}") for i, c in enumerate(carries)))).select(*by, "some", *(F.col(p).alias(p) for p in planes), level)
        out = out.select(*by, "some", *planes, F.col(f"{level}.p").alias(f"p{len(planes)}"), level)
        planes.append(f"p{len(planes)}")
        held = [F.col(f"{level}.c{i}") for i in range(len(carries))]
    return out.select(*by, "some", *planes, held[0].alias(f"p{len(planes)}"))


def hashed(docs: DataFrame, doc_id: str, text: str, most: int = _MOST_WORDS) -> DataFrame:
    """row, doc, line, node, chars, sim of every line that isn't blank: votes are summed per line of each row, repeated or not, and combined before they are shuffled. Lines of more than most words have sums of their own."""
    by = ["copy", "row", "doc", "line", "node", "chars"]
    words = lambda lines: lines.select("copy", "row", "doc", "line", "node", F.length("norm").alias("chars"), F.split("norm", " ").alias("words"))
    voted = lambda some: some.select(*by, F.explode("words").alias("word")).select(*by, F.xxhash64("word").alias("h")).groupBy(*by)
    lines = once(occurrences(docs, doc_id, text), "words", F.split("norm", " ")).where(F.size("words") <= most)
    planes = _planes(lines.select("copy", "row", "doc", "line", "node", F.length("norm").alias("chars"), "words"), "words", by)
    votes = [F.expr("sum(" + " + ".join(f"{1 << p}L * (shiftrightunsigned(p{p}, {i}) & {_ONES}L)" for p in range(TOGETHER.bit_length())) + ")").alias(f"v{i}") for i in range(LANE)]
    summed = planes.groupBy(*by).agg(F.sum("some").alias("total"), *votes)
    guard, need = f"{(1 << GUARD) * _ONES}L", f"(total div 2 + 1) * {_ONES}L"
    bits = " | ".join(f"shiftleft(shiftrightunsigned(v{i} + {guard} - {need}, {GUARD}) & {_ONES if i + 2 * LANE < 64 else 1 | 1 << LANE}L, {i})" for i in range(LANE))
    short = summed.select("row", "doc", "line", "node", "chars", F.expr(bits).alias("sim"))
    wide = voted(words(occurrences(docs.where(F.length(text) > 2 * most), doc_id, text)).where(F.size("words") > most))
    sums = wide.agg(F.count("*").alias("total"), *(F.expr(f"sum(shiftrightunsigned(h, {i}) & 1L)").alias(f"v{i}") for i in range(64)))
    bits = " | ".join(f"shiftleft(cast(2 * v{i} > total as bigint), {i})" for i in range(64))
    return short.union(sums.select("row", "doc", "line", "node", "chars", F.expr(bits).alias("sim")))


def key_numbers(lines: int) -> range:
    """The numbers of the keys by which so many lines meet."""
    return range(N_FEW) if lines <= MANY else range(N_FEW, len(KEYS))


def _key(number: Column, sim: Column) -> Column:
    """Key of this number: a hash of it and of its blocks' bits."""
    masks = [_signed(sum(((1 << width) - 1) << at for at, width in (BLOCKS[j] for j in t))) for t in KEYS]
    return F.xxhash64(sim.bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), number + 1)), number)


def keys_of(sim: str, numbers: range = range(N_FEW)) -> Column:
    """The keys of these numbers."""
    return F.array(*(_key(F.lit(n), F.col(sim)) for n in numbers))


def _texts(docs: DataFrame, doc_id: str, text: str, inside: DataFrame, needed: DataFrame) -> DataFrame:
    """node and norm of the needed nodes, from one document each; bit tables of fixed size are broadcast, so that most other documents stop at the scan, and most other lines before they are shuffled."""
    rows = inside.join(needed, "node").select("row").distinct()
    keyed = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), key_of(F.col(doc_id), F.col(text)).alias("_row"))
    lines = occurrences(_passing(keyed, "_row", rows), "doc", "text").select("node", "norm")
    some = _passing(lines, "node", needed.select(F.col("node").alias("row")))
    return some.join(needed, "node").groupBy("node").agg(F.first("norm").alias("norm"))


def _passing(df: DataFrame, key: str, needed: DataFrame) -> DataFrame:
    """The rows of df whose key is one of needed (row), and few others. Inner joins: a semi-join would be pushed below the table."""
    bit = lambda c: F.expr(f"{c} & {(1 << NEED_BITS) - 1}L")
    table = needed.select(bit("row").alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_bits"))
    some = df.withColumn("_bit", bit(key)).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(table), "_word")
    return some.where(F.expr("shiftrightunsigned(_bits, cast(_bit & 63 as int)) & 1 = 1")).select(*df.columns)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b): those whose edit similarity reaches the limit. Joins on a and b are between plain shuffles, so a hot line is split."""
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "norm": "l"}), "a").join(texts.withColumnsRenamed({"node": "b", "norm": "r"}), "b")
    most = f"cast(greatest(length(l), length(r)) * {100 - percent} div 100 as int)"
    return both.where(F.expr(f"levenshtein(l, r, {most}) >= 0")).select("a", "b")


def _may(sim: Column, chars: Column, other_sim: Column, other_chars: Column, bits: int, percent: int) -> Column:
    """Whether SimHashes and lengths allow a link."""
    return (F.bit_count(sim.bitwiseXOR(other_sim)) <= bits) & (F.least(chars, other_chars) * 100 >= F.greatest(chars, other_chars) * percent)


def _meet(sim: Column, other_sim: Column, before: Column) -> Column:
    """Whether the key of this group is the first that two SimHashes have in common: pairs of several keys are compared under one."""
    apart = sim.bitwiseXOR(other_sim)
    equal = [F.when(apart.bitwiseAND(F.lit(_signed(((1 << width) - 1) << at))) == 0, F.lit(1 << j)).otherwise(F.lit(0)) for j, (at, width) in enumerate(BLOCKS)]
    return functools.reduce(Column.bitwiseOR, equal).bitwiseAND(before) == 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _before(number: Column) -> Column:
    """Of the key of this number: the blocks that it passes over, as bits. Two that have one of these in common too have a key before this."""
    passed = [sum(1 << j for j in range(0 if n < N_FEW else len(FEW_KEYS[0]), max(t)) if j not in t) for n, t in enumerate(KEYS)]
    return F.element_at(F.array(*map(F.lit, passed)), (number + 1).cast("int"))


def _grouped(nodes: DataFrame, bits: int, percent: int) -> DataFrame:
    """key (of blocks, and of a run of lengths that a link can bridge), salt, before, node, sim, chars of the nodes that share a key with another; a very frequent key is dealt over tasks by salt. The sketch that says which are frequent reads one line of SEEN by hash; it only decides how they are dealt.

    Of runs of fewer than SMALL nodes only those stay that SimHash and length allow to be linked to another of the run,
    and that have no earlier key in common with it: most that share a key by chance end here.
    """
    lines = nodes.count()
    numbers = key_numbers(lines)
    some = nodes.where(F.pmod("node", F.lit(SEEN)) == 0).select(F.explode(keys_of("sim", numbers)).alias("key"))
    found = some.agg(F.expr(f"approx_top_k(key, {MOST_HOT}, {TRACKED})").alias("top")).select(F.explode("top").alias("x"))
    hot = found.where(F.col("x.count") * SEEN > GROUP).select(F.col("x.item").alias("key"), F.ceil(F.col("x.count") * SEEN / F.lit(float(GROUP))).cast("int").alias("parts"))
    keyed = nodes.select("node", "sim", "chars", F.explode(F.array(*map(F.lit, numbers))).alias("number"))
    # number, length and salt + 1 travel as one number; the key is made of these and the SimHash again where it is needed
    salt = F.coalesce(F.pmod(F.xxhash64("node"), "parts") + 1, F.lit(0).cast("bigint"))
    packed = F.col("number") + F.shiftleft(F.col("chars").cast("bigint"), 5) + F.shiftleft(salt, 36)
    sent = keyed.join(F.broadcast(hot), _key(F.col("number"), F.col("sim")) == F.col("key"), "left").select("node", "sim", packed.alias("packed"))
    number = F.col("packed").bitwiseAND(F.lit(31)).cast("int")
    salt = (F.shiftrightunsigned("packed", 36) - 1).cast("int")
    own = F.xxhash64(_key(number, F.col("sim")), salt)
    bucket = F.pmod(own, F.lit(max(1, lines * len(numbers) // BUCKET)))
    chars = F.shiftrightunsigned("packed", 5).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    dealt = sent.repartition(bucket).select(bucket.alias("bucket"), own.alias("own"), "node", "sim", chars.alias("chars"), "packed")
    # by length; a line that is too long for the one before it starts a run of its own. Most keys have one line: they go first, many keys at a time
    group = Window.partitionBy("bucket").orderBy("own", "chars", "node")
    last, far = F.struct("own", "chars"), lambda x, y: F.coalesce((x.own != y.own) | (x.chars * F.lit(100).cast("bigint") < y.chars * F.lit(percent)), F.lit(True))
    both = dealt.select("*", F.lag(last).over(group).alias("x"), F.lead(last).over(group).alias("z"))
    both = both.where(~(far(F.col("x"), last) & far(last, F.col("z"))) | (salt >= 0))
    group = Window.partitionBy("bucket", "own").orderBy("chars", "node")
    both = both.select("bucket", "own", "node", "sim", "chars", number.alias("number"), salt.alias("salt"), far(F.col("x"), last).alias("starts"), F.row_number().over(group).alias("place"))
    first = F.last(F.when(F.col("starts"), F.struct("place", "chars")), ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.select("bucket", "own", "number", "salt", "node", "sim", "chars", "place", first.alias("first"))
    part = F.floor((F.col("place") - F.col("first.place")) / SMALL)
    runs = both.groupBy("bucket", "own", "number", "salt", F.col("first.chars").alias("run"), part.alias("part")).agg(F.collect_list(F.struct("node", "sim", "chars")).alias("m"))
    near = lambda x, y: (x.node != y.node) & _may(x.sim, x.chars, y.sim, y.chars, bits, percent) & _meet(x.sim, y.sim, F.col("before"))
    whole = (F.col("salt") < 0) & (F.col("part") == 0) & (F.size("m") < SMALL)
    kept = F.when(whole, F.filter("m", lambda x: F.exists("m", lambda y: near(x, y)))).otherwise(F.col("m"))
    left = runs.withColumn("before", _before(F.col("number"))).select("own", "number", "salt", "run", "before", F.explode(kept).alias("x"))
    key = F.when(F.col("salt") < 0, F.xxhash64("own", "run")).otherwise(_key(F.col("number"), F.col("x.sim")))
    return left.select(key.alias("key"), "salt", "before", "x.*")


def _with_pivots(runs: DataFrame) -> DataFrame:
    """runs (with n, how often a line occurs) with pivot (node, sim, chars): of the same key and salt the line that occurs most often, as what others were copied from does, or else any."""
    group = Window.partitionBy("key", "salt").orderBy(F.desc("n"), F.xxhash64("node"), "node")
    return runs.select("key", "salt", "before", "node", "sim", "chars", F.first(F.struct("node", "sim", "chars")).over(group).alias("pivot"))


def _to_pivots(shared: DataFrame, bits: int, percent: int) -> DataFrame:
    """a (a pivot), b, and the number of bits in which they differ, of those that SimHashes and lengths allow to be linked: every node and its pivots, and the pivots of one key's salts and the first of them."""
    heads = shared.where("salt >= 0").select("key", F.col("pivot").alias("x")).distinct()
    across = heads.join(heads.groupBy("key").agg(F.min("x").alias("pivot")), "key").select("pivot", "x")
    both = shared.select("pivot", F.struct("node", "sim", "chars").alias("x")).union(across).where("pivot.node <> x.node")
    some = both.where(_may(F.col("pivot.sim"), F.col("pivot.chars"), F.col("x.sim"), F.col("x.chars"), bits, percent))
    return some.select(F.col("pivot.node").alias("a"), F.col("x.node").alias("b"), F.bit_count(F.col("pivot.sim").bitwiseXOR(F.col("x.sim"))).alias("bits"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(lines: row, doc, line, node, chars, sim; labels: node, label of the nodes that are linked to others)."""
    table = written(hashed(docs, doc_id, text), "lines")
    settle(docs.sparkSession)
    nodes = written(table.groupBy("node").agg(F.first("sim").alias("sim"), F.first("chars").alias("chars"), F.min("row").alias("row"), F.count("*").alias("n")), "nodes")
    runs = written(_grouped(nodes, bits, percent), "runs")
    settle(docs.sparkSession)
    inside = written(nodes.select("node", "row", "n").join(runs.select("node").distinct(), "node", "left_semi"), "inside")
    dropped(nodes)
    shared = written(_with_pivots(runs.join(inside.select("node", "n"), "node")), "shared")
    dropped(runs)
    met = _to_pivots(shared, bits, percent)
    stars = written(met.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select("x.a", "b"), "stars")
    near = written(_verified(stars, written(_texts(docs, doc_id, text, inside, _ends(stars)), "texts"), percent), "near")
    labels = components(near)
    # what the pivots didn't settle: first one candidate for each line and component, then all that are still apart
    tried = stars
    for last in (False, True):
        known = shared.join(labels, "node", "left").select("key", "before", "node", "sim", "chars", F.coalesce("label", "node").alias("label"))
        counted = known.groupBy("key", "label").agg(F.count("*").alias("m"))
        mixed = counted.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.count("*").alias("k")).where("k > 1").select("key", "top")
        open_ = written(known.join(mixed, "key"), "open")
        left = open_.where("label <> top").select("key", F.col("node").alias("b"), F.col("label").alias("other"), F.col("sim").alias("b_sim"), F.col("chars").alias("b_chars"))
        rest = left.join(open_, "key").where("label <> other AND (label = top OR b < node)").where(_may(F.col("sim"), F.col("chars"), F.col("b_sim"), F.col("b_chars"), bits, percent) & _meet(F.col("sim"), F.col("b_sim"), F.col("before")))
        apart = F.bit_count(F.col("sim").bitwiseXOR(F.col("b_sim")))
        if not last:
            rest = rest.groupBy("b", "label").agg(F.min(F.struct(apart.alias("bits"), F.col("node").alias("a"))).alias("x")).select(F.col("x.a").alias("a"), "b")
        else:
            rest = rest.select(F.col("node").alias("a"), "b")
        rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = written(rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
        dropped(open_)
        if not rest.limit(1).count():
            break
        more = written(_verified(rest, written(_texts(docs, doc_id, text, inside, _ends(rest)), "texts"), percent), "more")
        before, tried = tried, written(tried.select("a", "b").union(rest), "tried")
        dropped(before)
        dropped(rest)
        if more.limit(1).count():
            before, near = near, written(near.union(more), "near")
            dropped(before)
            dropped(labels)
            labels = components(near)
        dropped(more)
    for t in (shared, tried, inside, near):
        dropped(t)
    settle(docs.sparkSession)
    return table, labels


def removals(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, percent: int = PERCENT) -> DataFrame:
    """row and the sorted numbers (from 0) of the lines that go, for each row that loses any."""
    table, labels = groups(docs, doc_id=doc_id, text=text, bits=bits, percent=percent)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "line", "row")
    first = table.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = first.groupBy("label").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1").select("label", "kept")
    nodes = written(first.select("node", "label").join(kept, "label").select("node", "kept"), "kept")
    gone = table.join(nodes, "node").where(~place.eqNullSafe(F.col("kept"))).select("row", "line").distinct()
    return written(gone.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("gone")), "gone")


def _left(lines: str, gone: str) -> Column:
    """What is left of the lines (a column) without those numbers (a column)."""
    return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i)), "\n")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, percent: int = PERCENT, drop_empty: bool = True) -> DataFrame:
    """The rows, with all their columns and without the lines that go; drop_empty: without rows that lost all their lines."""
    row, gone, left, lines = fresh(docs, "_row", "_gone", "_left", "_lines")
    found = removals(docs, doc_id=doc_id, text=text, bits=bits, percent=percent).withColumnsRenamed({"row": row, "gone": gone})
    both = docs.withColumn(row, key_of(F.col(doc_id), F.col(text))).join(found, row, "left")
    both = once(both, lines, F.when(F.col(gone).isNotNull(), F.split(F.col(text), "\n", -1)))
    both = both.withColumn(left, F.when(F.col(gone).isNull(), F.col(text)).otherwise(_left(lines, gone)))
    if drop_empty:
        both = both.where(F.col(gone).isNull() | (F.trim(F.regexp_replace(left, r"\s+", " ")) != ""))
    return both.select(*(F.col(left).alias(c) if c == text else F.col(c) for c in docs.columns))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (not blank), n_kept, and text_sha256 of what is left of each document (null text: as if empty)."""
    pair = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = removals(pair, bits=bits, percent=percent)
    both = pair.withColumn("row", key_of(F.col("doc_id"), F.col("text"))).join(found, "row", "left")
    both = once(both, "lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    left = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_left("lines", "gone"))
    n = F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(_BLANK)) != "")).cast("bigint")  # what normalises to nothing
    return both.select("doc_id", n.alias("n_lines"), (n - F.coalesce(F.size("gone"), F.lit(0))).alias("n_kept"), F.sha2(left.cast("binary"), 256).alias("text_sha256"))
