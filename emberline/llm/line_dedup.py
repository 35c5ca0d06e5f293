"""Fuzzy line deduplication by MinHash, in SQL functions only.

A line's shingles are its runs of `CHARS` characters, one from each place, in
lower case; a shorter line is one shingle. Minima of their hashes form its
signature; lines that agree in one of the bands of the signature lie in one
bucket, and pairs with an exact Jaccard similarity of the shingle sets of at
least the threshold are links. Distributed union-find joins them to components,
of which the first line, by document and position, is kept.

Equal lines are one before anything else. Three bits of each minimum make a sketch
that tells pairs that cannot be alike; lines without a plausible partner in
their bucket go. The others are compared

1. with the bucket's leader, its line of the least id;
2. where lines of a bucket are still in several components, with the line that
   has the most company in its buckets, the middle of a group of variants;
3. where they still are, with every plausible line of the bucket in another
   component.

So every alike pair of a bucket ends in one component, at any size of the
bucket. Buckets that hold much of the corpus are split by salts for the first
step, and the leaders of the parts are compared among themselves. Shingle sets
are made where a pair is verified; in the third step, where a line may have many
partners, they are made once for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from emberline.operators.components import connected

from .common import F, discard, fresh_name, quoted, stored, whole_text

CHARS = 5
BANDS, ROWS = 10, 4  # a pair at 0.8 meets in some band with a probability of 0.995, at 0.85 of 0.9994, at 0.9 of 0.99997
TOGETHER = 4  # shingles that meet the minima of a line in one row
SPLIT_ROWS = 10_000  # lines of a bucket beyond which it is split
SKETCHED = 3  # last bits of each minimum, those of 20 minima in a word
_OTHER = " + ".join(f"bit_count(({z} | shiftright({z}, 1) | shiftright({z}, 2)) & {sum(1 << SKETCHED * k for k in range(BANDS * ROWS // 2))}L)" for z in ("(x1 ^ x2)", "(y1 ^ y2)"))
#: The last three bits of 40 minima agree for 33 of them on average at a similarity of 0.8; fewer than 24 have a probability of 2e-4.
_PLAUSIBLE = f"{_OTHER} <= {BANDS * ROWS} - 24"
PROBE = 64  # one line of so many tells which buckets are to be split


def _codes(line: str = "line") -> Column:
    """The line in lower case, four bytes a character, so that any run of characters is found by its place."""
    return F.encode(F.lower(F.col(line)), "UTF-32")


def _starts(codes: str = "codes") -> str:
    return f"sequence(1, greatest(octet_length({codes}) - {4 * (CHARS - 1)}, 1), 4)"


def _masks(n: int) -> list[int]:
    """Signed 32-bit masks; the least hash under an exclusive or is the minimum in another order of all hashes. Their first bits are spread evenly, so that they choose apart."""
    x, out = 0x2545F4914F6CDD1D, []
    for k in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        mask = ((k * (1 << 32) // n) & (0x3F << 26)) ^ (x >> 38)
        out.append(mask - (1 << 32) if mask >> 31 else mask)
    return out


def lines_of(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, pos, id, line) of the lines that take part, all but blank ones; id is the line's hash."""
    rows = documents.select(F.col(quoted(id_column)).alias("doc"), F.posexplode_outer(F.split(whole_text(text_column), "\n")).alias("pos", "line"))
    return rows.where("trim(line) <> ''").select("doc", "pos", F.xxhash64("line").alias("id"), "line")


def _band_keys(lines: DataFrame) -> DataFrame:
    """(id, keys, x, y): the bucket of each band, and the last bits of each minimum of the first and the second half, for lines (id, line)."""
    # equal lines meet before their shingles are made, which are not dealt out again; each task has one of a kind to send, however common a line is
    lines = lines.groupBy("id").agg(F.first("line").alias("line"))
    # `TOGETHER` shingles in a row, as an update of 40 minima costs more than the shingles; past the end the last one stands again
    coded = lines.select("id", _codes().alias("codes")).select("id", "codes", F.expr(f"greatest(octet_length(codes) - {4 * CHARS - 1}, 1)").alias("last"))
    # outer, though never empty: else the optimizer makes the codes once more in a filter of its own
    runs = coded.select("id", "codes", "last", F.explode_outer(F.expr(f"sequence(1, last, {4 * TOGETHER})")).alias("at"))
    h = [F.hash(F.substring("codes", F.least(F.col("at") + 4 * j, "last"), F.lit(4 * CHARS))).alias(f"h{j}") for j in range(TOGETHER)]
    least = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(TOGETHER)])).alias(f"m{k}") for k, m in enumerate(_masks(BANDS * ROWS))]
    # in array functions, since one generated method for all of this is too long for the JVM to compile
    signed = runs.select("id", *h).groupBy("id").agg(*least).select("id", F.array(*[f"m{k}" for k in range(BANDS * ROWS)]).alias("m"))
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("m")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])
    half = BANDS * ROWS // 2
    words = [F.expr(f"aggregate(slice(m, {at}, {half}), 0L, (a, v) -> shiftleft(a, {SKETCHED}) | (v & {(1 << SKETCHED) - 1}))") for at in (1, 1 + half)]
    return signed.select("id", keys.alias("keys"), words[0].alias("x"), words[1].alias("y"))


def _buckets(keys: DataFrame, split_rows: int) -> DataFrame:
    """(key, salt, id) of the lines that are not alone in their bucket; a large bucket has parts, told by salts, and all its lines stay."""
    rows = keys.select("id", F.explode("keys").alias("key"))
    # which parts a bucket has does not change what is found; some 100,000 * BANDS buckets of one in 100,000 lines are the most there can be
    split_rows = max(split_rows, keys.count() // 100_000)
    probe = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(PROBE)) == 0).groupBy("key").agg((F.count("*") * PROBE).alias("lines"))
    large = probe.where(F.col("lines") > split_rows).select("key", F.ceil(F.col("lines") / split_rows).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(large), "key", "left").select("key", F.pmod(F.xxhash64(F.lit(4), "id"), F.col("parts")).alias("salt"), "id")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "salt"))).where("n > 1 or salt is not null").drop("n")


def _live(rows: DataFrame, more: str = "key", fit: str = "true") -> DataFrame:
    """Of rows (key, id, c, x, y, ...), those with a plausible partner of another component in their bucket; a further condition may look at one more column."""
    other = rows.select(*[F.col(name).alias(f"{name}2") for name in sorted({"key", "c", "x", "y", more})])
    own = rows.withColumnsRenamed({"x": "x1", "y": "y1"})
    return own.join(other, F.expr(f"key = key2 and c <> c2 and {_PLAUSIBLE} and {fit}"), "left_semi").withColumnsRenamed({"x1": "x", "y1": "y"})


def _set(line: str) -> str:
    """The shingle set of a line, as an array of hashes; the codes are bound to a name, so that they are made once."""
    runs = f"array_distinct(transform({_starts()}, i -> xxhash64(substring(codes, i, {4 * CHARS}))))"
    return f"transform(array(encode(lower({line}), 'UTF-32')), codes -> {runs})[0]"


def _reaches(overlap: str, sizes: str, threshold: float) -> str:
    """Whether the overlap of two sets is the threshold's share of their union; whole numbers, so that a hair of rounding is no matter."""
    t = float(threshold)
    return f"{overlap} * {1 + t}D >= {t}D * ({sizes}) - 1e-9D"


def _alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold; texts (id, line) hold all lines named."""
    both = pairs.join(texts.toDF("a", "l1"), "a").join(texts.toDF("b", "l2"), "b")
    # sizes and overlap in one array, so that no set is made twice
    sizes = "transform(array(named_struct('x', s1, 'y', s2)), s -> array(size(s.x), size(s.y), size(array_intersect(s.x, s.y))))[0]"
    sized = both.select("a", "b", F.expr(_set("l1")).alias("s1"), F.expr(_set("l2")).alias("s2")).select("a", "b", F.expr(sizes).alias("n"))
    return sized.where(_reaches("n[2]", "n[0] + n[1]", threshold)).select("a", "b")


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b), the lesser id first, of rows (id, x, y, other) where other is a struct of the same and the two may be alike."""
    both = rows.select("id", "other.id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("other.x").alias("x2"), F.col("other.y").alias("y2")).toDF("i", "j", "x1", "y1", "x2", "y2")
    return both.where(f"i <> j and {_PLAUSIBLE}").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _merged(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with an id and its component c, after new links (a, b) have joined components that are at most two links apart.

    That takes in a whole star. Components that stay apart though links join
    them cost comparisons, but lose nothing, as all links are joined in the end.
    """
    label = rows.select("id", "c").distinct()
    joined = links.join(label.toDF("a", "u"), "a").join(label.toDF("b", "v"), "b").select("u", "v")
    edges = stored(joined.unionAll(joined.select("v", "u")).unionAll(joined.select("u", "u")).unionAll(joined.select("v", "v")).distinct(), "edges")
    once = edges.groupBy("u").agg(F.min("v").alias("m"))
    twice = edges.join(once.toDF("v", "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
    return rows.join(twice.toDF("c", "component"), "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component")


def _across(live: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The alike pairs (a, b) among those of a bucket's lines (key, id, c, x, y) that are in different components.

    Lines carry their sets to their buckets; a pair is verified in the least
    bucket that both share.
    """
    rows = live.select("key", "id", "c", "x", "y").join(live.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    rows = stored(_live(rows, "keys", "array_min(array_intersect(keys, keys2)) = key"), "live")
    sets = texts.join(rows, "id", "left_semi").select("id", F.expr(_set("line")).alias("set"))
    ready = stored(rows.join(sets, "id"), "ready")
    left, right = (ready.select("key", F.size("set").alias(f"n{n}"), *[F.col(name).alias(f"{name}{n}") for name in ("id", "c", "x", "y", "keys", "set")]) for n in (1, 2))
    same = f"id1 < id2 and c1 <> c2 and {_PLAUSIBLE} and least(n1, n2) >= {float(threshold)}D * greatest(n1, n2) and array_min(array_intersect(keys1, keys2)) = key"
    met = left.join(right, "key").where(f"{same} and {_reaches('size(array_intersect(set1, set2))', 'n1 + n2', threshold)}")
    out = stored(met.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct(), "links")
    discard(rows, ready)
    return out


def links(lines: DataFrame, threshold: float = 0.8, split_rows: int | None = None) -> DataFrame:
    """(a, b) for lines (id, line) with different ids: pairs whose exact Jaccard similarity reaches the threshold, so many that any two such lines of one bucket are connected. Rows that repeat a line do no harm."""
    keys = stored(_band_keys(lines), "keys")
    met = stored(_buckets(keys, SPLIT_ROWS if split_rows is None else split_rows), "met")
    live = stored(_live(met.join(keys.drop("keys"), "id").withColumn("c", F.col("id"))), "live")
    discard(keys, met)
    texts = stored(lines.select("id", "line").join(live.select("id").distinct(), "id", "left_semi").distinct(), "texts")

    # the leader of a bucket, or of each of its parts, and the first among these
    me = F.struct("id", "x", "y")
    led = live.withColumn("other", F.min(me).over(Window.partitionBy("key", "salt")))
    heads = live.where("salt is not null").groupBy("key", "salt").agg(F.min(me).alias("me"))
    heads = heads.select("key", "me.*").join(heads.groupBy("key").agg(F.min("me").alias("other")), "key")
    found = stored(_alike(_pairs(led).unionAll(_pairs(heads)).distinct(), texts, threshold), "links")
    now = stored(_live(_merged(live, found)), "live")
    # the middle of a bucket: the line with the most lines in its buckets
    sizes = live.groupBy("key").agg(F.count("*").alias("n"))
    score = now.select("key", "id").join(sizes, "key").groupBy("id").agg(F.sum("n").alias("score"))
    middle = now.join(score, "id").groupBy("key").agg(F.max_by(F.struct("id", "x", "y", "c"), F.struct("score", "id")).alias("other"))
    more = stored(_alike(_pairs(now.join(middle, "key").where("c <> other.c")).distinct(), texts, threshold), "links")
    last = stored(_live(_merged(now, more)), "live")
    rest = _across(last, texts, threshold)
    discard(live, texts, now, last)
    return found.unionAll(more).unionAll(rest)


def dropped(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc, pos, id) of the lines to drop; id is the line's hash."""
    lines = lines_of(documents, id_column, text_column)
    roots = connected(links(lines, threshold))
    class_of = lines.select("doc", "pos", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("doc", "pos", "id", F.coalesce("component", "id").alias("class"))
    firsts = class_of.groupBy("class").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "pos", "id")).alias("first")).where("n > 1")
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos")) & (F.col("id") == F.col("first.id"))
    return class_of.join(firsts, "class").where(~same).select("doc", "pos", "id")


def dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents with their columns, each text without the lines that repeat earlier ones, and n_lines and n_dropped added.

    Lines end at line feeds. Lines of blanks stay always, as do texts without
    lines to drop, byte by byte; a text that loses all its lines becomes empty
    and stays a row. Null text stays null. Lines shorter than a shingle are alike
    if they are equal, letter case aside; lines with equal 64-bit hashes count as
    equal. First is the least document id, then the least position; null ids come
    last. Rows that repeat an id count as one document, so that both keep its
    first lines. An empty table gives no rows. The added columns get other names
    where the documents have theirs.
    """
    names = documents.columns
    gone, lines, count = (fresh_name(names, n) for n in ("gone", "n_lines", "n_dropped"))
    drop = dropped(documents, id_column, text_column, threshold).repartition("doc")
    # the hashes to drop at each place of a document, found by place, so that long texts take no search
    drop = drop.groupBy("doc", "pos").agg(F.collect_set("id").alias("ids")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("g"))
    at_place = "flatten(transform(g, (x, i) -> concat(array_repeat(cast(null as array<bigint>), x.pos - 1 - if(i = 0, -1, get(g, i - 1).pos)), array(x.ids))))"
    drop = drop.select("doc", F.expr(at_place).alias(gone))
    joined = documents.alias("d").join(drop.alias("x"), F.col(f"d.{quoted(id_column)}").eqNullSafe(F.col("x.doc")), "left").select("d.*", gone)
    parts = F.split(F.col(quoted(text_column)), "\n")
    kept = F.filter(parts, lambda line, at: ~F.coalesce(F.array_contains(F.get(F.col(gone), at), F.xxhash64(line)), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col(quoted(text_column))).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(quoted(text_column)).isNull(), 0).otherwise(F.size(parts))
    left = F.when(F.col(gone).isNull(), n).otherwise(F.size(kept))
    return joined.select(*[text.alias(c) if c == text_column else F.col(quoted(c)) for c in names], n.cast("long").alias(lines), (n - left).cast("long").alias(count))
