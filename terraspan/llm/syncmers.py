"""Document fingerprints from closed syncmers, in DataFrame functions only.

The text's words are hashed; a k-mer is 4 neighbouring words, its inner substrings the 3 pairs of neighbours in it. A
k-mer is an anchor if its least pair lies at an edge (first or last). Whether it is depends on the k-mer alone, so an
edit can only change the anchors it touches. Three marks stand before the first word, so that short texts have k-mers.

The fingerprint is the SKETCH least distinct hashes of the anchors, each as 8 hex digits. The likeness of two is the
share of anchors that agree, 2m / (n1 + n2), taken over the least hashes of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm import common
from terraspan.llm.sharding import KEY_BITS, ROW_BYTES, part_of, small, splitters

#: Hashes in a fingerprint, at most.
SKETCH = 64
#: Bytes of text in a range of documents, about.
RANGE = 16 << 20
#: Ranges whose bounds are counted; ranges that are numbered together.
COARSE, GROUP = 256, 1024


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once: lambda variables aren't inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The runs of bytes other than space and the control characters 9 to 13."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def pairs(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words, with three marks before the first word; none for texts without words."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    marks = F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))
    return let(hashes, lambda h: F.when(F.size(h) > 0, let(F.concat(marks, h), lambda m: F.transform(m, lambda x, i: F.xxhash64(x, F.get(m, i + 1))))).otherwise(F.array().cast("array<bigint>")))


def chosen(p: Column, make) -> Column:
    """make(first pair, last pair, place) of each k-mer that is a closed syncmer; p has one entry too many, for the last word."""
    n = F.size(p) - 3

    def pick(x: Column, i: Column) -> Column:
        last = F.get(p, i + 2)
        return F.when((i < n) & (F.least(x, last) <= F.get(p, i + 1)), make(x, last, i))

    return F.array_compact(F.transform(p, pick))


def anchors(text: Column) -> Column:
    """All anchors, in order: the place of the k-mer's last word and the k-mer's hash, for matching by position."""
    return let(pairs(text), lambda p: chosen(p, lambda a, b, i: F.struct(i.alias("at"), F.xxhash64(a, b).alias("hash"))))


def matched(pairs: DataFrame, pair: str = "pair", left: str = "left", right: str = "right") -> DataFrame:
    """(pair, n_left, n_right, shift, n_shift): how two texts match by the places of their anchors, a row for each row of pairs.

    n_left and n_right: the distinct anchors of each text; shift: by how many words the right text lies further on where
    most anchors agree (of equally many the least), null if none agree; n_shift: how many agree there. Of an anchor that
    a text repeats, the first place counts. pair has to be unique; null texts count as empty.
    """
    side = lambda c, at: pairs.select(F.col(pair), F.explode(anchors(common.text_or_empty(c))).alias("x")).groupBy(pair, F.col("x.hash").alias("hash")).agg(F.min("x.at").alias(at))
    both = side(left, "a").join(side(right, "b"), [pair, "hash"], "full")
    counts = both.groupBy(pair, (F.col("b") - F.col("a")).alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("l"), F.count("b").alias("r"))
    best = F.max_by(F.struct("shift", "n"), F.when(F.col("shift").isNotNull(), F.struct("n", (-F.col("shift")).alias("least"))))
    found = counts.groupBy(pair).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), best.alias("best"))
    none = F.lit(0).cast("long")
    return pairs.select(pair).join(found, pair, "left").select(pair, F.coalesce("n_left", none).alias("n_left"), F.coalesce("n_right", none).alias("n_right"), "best.shift", F.coalesce("best.n", none).alias("n_shift"))


def _least(p: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(chosen(p, lambda a, b, _: F.shiftrightunsigned(F.xxhash64(a, b), 32)))), 1, SKETCH)


def _placed(p: Column) -> Column:
    return chosen(p, lambda a, b, i: F.xxhash64(F.xxhash64(a, b), i))


def sketch(text: Column) -> Column:
    """The least hashes of the anchors: what a fingerprint is made of."""
    return let(pairs(text), _least)


def placed(text: Column) -> Column:
    """Each anchor with its place, as one number: texts share those that stand at the same place in both."""
    return let(pairs(text), _placed)


def placed_likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of all anchors of two texts, given by placed(), that stand at the same place; texts without anchors are alike."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def shown(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two sketches; texts without anchors are alike."""
    def of(union: Column) -> Column:
        own = lambda s: F.size(F.array_intersect(s, union))
        both = F.size(F.array_intersect(F.array_intersect(a, b), union))
        return F.when(F.size(union) == 0, 1.0).otherwise(2.0 * both / (own(a) + own(b)))

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), of)


def ranges(keys: DataFrame, parts: int):
    """What adds __part to rows (__major, __minor): about equal bytes, ascending with the keys. Also, how many parts there are.

    The first COARSE bounds are sought by counts of bytes; each of these ranges then has equal steps of the key.
    """
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    coarse = min(COARSE, parts)
    cuts = splitters(keys, total, coarse, total // coarse // 20) if total and coarse > 1 else []
    steps = -(-parts // coarse)
    named = keys.select(F.col("major").alias("__major"), F.col("minor").alias("__minor"))
    spans = part_of(named, cuts).groupBy("__part").agg(F.min("__major").alias("__low"), F.max("__major").alias("__high"))  # COARSE rows at most

    def placed(rows: DataFrame) -> DataFrame:
        own = part_of(rows, cuts)
        if steps == 1:
            return own
        one = F.col("__low") == F.col("__high")
        share = F.when(one, F.col("__minor") / F.lit(float(1 << KEY_BITS))).otherwise((F.col("__major") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1))
        return own.join(F.broadcast(spans), "__part").withColumn("__part", F.col("__part") * steps + F.least(F.floor(share * steps), F.lit(steps - 1)).cast("int")).drop("__low", "__high")

    return placed, coarse * steps


def before(firsts: DataFrame) -> DataFrame:
    """Adds to rows, one for each __part, the __part before that has a row; to the first of all, the last."""
    groups = firsts.withColumn("__g", F.floor(F.col("__part") / GROUP))
    own = groups.withColumn("__before", F.lag("__part").over(Window.partitionBy("__g").orderBy("__part")))
    # a row for GROUP parts, so the one task has few of them
    last, w = groups.groupBy("__g").agg(F.max("__part").alias("__last")), Window.orderBy("__g")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = last.select("__g", F.coalesce(F.lag("__last").over(w), F.max("__last").over(every)).alias("__last"))
    return own.join(ends, "__g").withColumn("__before", F.coalesce("__before", "__last")).drop("__g", "__last")


def with_next(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Window]:
    """(__id, __text, __sketch, __ghost, __part, __minor) in ranges of ascending ids, and the window in which the next row is the next document.

    The first row of each range also stands, as a ghost, at the end of the range before; the first of all at the end.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), common.text_or_empty(text).alias("__text"))
    low, high, size = rows.agg(F.min("__id"), F.max("__id"), F.sum(F.octet_length("__text"))).first()
    low = 0 if low is None else low
    # ids as keys of KEY_BITS: null ones first, the first bits used, so that one round of counts tells ranges apart
    bits = ((high or 0) - low + 1).bit_length() + 1
    shift, lift = max(0, bits - KEY_BITS), max(0, KEY_BITS - bits)
    major = F.when(F.col("__id").isNull(), F.lit(0).cast("long")).otherwise(F.shiftleft(F.shiftright(F.col("__id") - F.lit(low) + F.lit(1 << shift), shift), lift))
    # ids that share a major key are never cut apart, unless they are the same id
    minor = F.shiftrightunsigned(F.xxhash64("__text"), 64 - KEY_BITS) if shift == 0 else F.lit(0).cast("long")
    rows = rows.withColumns({"__major": major, "__minor": minor})
    keys = common.save(rows.select("__id", (F.octet_length("__text").cast("long") + ROW_BYTES).alias("size"), F.col("__major").alias("major"), F.col("__minor").alias("minor")), "keys")
    placed, parts = ranges(keys, max(common.shuffle_partitions(spark), int(size or 0) // RANGE))
    order = [F.asc_nulls_first("__id"), F.asc("__minor")]
    marks = placed(keys.select("__id", F.col("major").alias("__major"), F.col("minor").alias("__minor")))
    first = marks.groupBy("__part").agg(F.min(F.struct(F.col("__id").isNotNull().alias("known"), "__id", "__minor")).alias("at"))
    ghost = small(before(first).select(F.col("at.__id").alias("g_id"), F.col("at.__minor").alias("g_minor"), F.col("__before").alias("__part")), parts)
    made = sketch(F.col("__text"))
    parted = placed(rows.withColumn("__sketch", made)).select("__id", "__text", "__sketch", "__minor", "__part", F.lit(False).alias("__ghost"))
    ahead = rows.join(ghost, F.col("__id").eqNullSafe(F.col("g_id")) & (F.col("__minor") == F.col("g_minor"))).select("__id", "__text", made.alias("__sketch"), "__minor", "__part", F.lit(True).alias("__ghost"))
    moved = parted.unionByName(ahead).repartitionById(parts, "__part")
    return moved, Window.partitionBy("__part").orderBy("__ghost", *order)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, placed_edited.

    A fingerprint is the SKETCH least hashes of the anchors, and near_edited and near_next estimate from those;
    placed_edited is exact: the share of all anchors of the text and its edited text that stand at one place in both.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next
    document, ascending doc_id; after the last comes the first. Null text counts as empty; texts without words have an
    empty fingerprint, and two of these have likeness 1. Null ids come first; rows of one id are in the order of a hash
    of their text. doc_id is a whole number. Other columns are ignored; an empty table gives no rows.
    """
    moved, window = with_next(docs, doc_id, text)
    # repeated rows may have repeated ghosts; the first of them is the next row, and all of them are alike
    seen = moved.withColumns({"__next": F.lead("__text").over(window), "__next_sketch": F.lead("__sketch").over(window)}).where(~F.col("__ghost"))
    n = F.length("__text")
    edited = seen.withColumn("__edited", F.concat(F.substring(F.col("__text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("__next"), F.lit(1), F.floor(n / 2).cast("int"))))
    # the sketch is worked out once, and what is made of it follows inside
    both = let(pairs(F.col("__edited")), lambda p: F.struct(_least(p).alias("sketch"), _placed(p).alias("placed")))
    made = edited.withColumn("__all", let(both, lambda s: F.struct(
        shown(F.col("__sketch")).alias("fingerprint"), shown(s["sketch"]).alias("edited_fingerprint"), likeness(F.col("__sketch"), s["sketch"]).alias("near_edited"),
        likeness(F.col("__sketch"), F.col("__next_sketch")).alias("near_next"), let(placed(F.col("__text")), lambda a: placed_likeness(a, s["placed"])).alias("placed_edited"))))
    return made.select(F.col("__id").alias(doc_id), n.cast("long").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "__all.fingerprint", "__all.edited_fingerprint", "__all.near_edited", "__all.near_next", "__all.placed_edited")


def query(spark, sf_dir):
    return fingerprints(common.documents(spark, sf_dir))
