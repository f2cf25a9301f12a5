"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

A text is the set of its word windows (five words, ASCII case folded); a text of one to four words is
one window. Each window is an element with a weight. Darts are thrown at the plane of weight and
rank of each element, from hashes of element and cell alone, so equal regions get equal darts. A
dart belongs to one of the signature's coordinates; each coordinate keeps its dart of least rank.
Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. The query
weighs every window 1, as its similarity is that of window sets.

Signatures are cut into bands; texts with an equal band meet in a bucket. Texts with equal windows
are one text from here on. Pairs whose sets differ too much in size for any link are no candidates.
At first all pairs are made in the smallest buckets only. In the others the text that
meets most others leads: it alone is checked against the others, and texts linked to it are in its
class. Members that the triangle inequality of the Jaccard distance keeps away from all other classes
leave. What may still link different classes is dealt anew, by an exact prefix filter: windows are ordered by
how few of these texts have them, and two texts of Jaccard similarity s share one of the first n + 1 - o
windows of each, o being the overlap that s asks for at their sizes. So texts meet in buckets of one window
(and two classes of sizes) only if one of their rarest windows is common: copies with edits of their own
have windows of their own in front and meet nobody. Buckets of at most ``FEW`` are done with all pairs of
different classes, and so are larger ones whose pairs of different classes are at most ``FEW`` times their texts; in
others the next leaders, of the smallest classes, are checked, and the rest is dealt again until one class is left in each. No link between different classes is lost, and the pairs of a large
bucket are not all made.

Defined cases: null texts and texts without words are alone in their class; repeated rows and ids
are in one class with their equals; an empty table gives no rows; other columns are not read. Memory
follows the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modcensus.llm.common import land, whole_text
from modcensus.llm.components import components
from modcensus.llm.vectext import lower_ascii, mix, portions, texts, uniform, word_windows
from modcensus.operators.joins import join_single

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 36, 6
LEADERS = 4  # times more leaders of a bucket in each round after the second
FIRST_FEW, FEW = 4, 24  # texts of a bucket whose pairs are all candidates, at first and later
MIDDLING = 1_000  # so many texts of a bucket too, if their pairs of different classes are at most FEW times as many
SIZE_STEP = 1.02  # between classes of sizes
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: chances of at most n darts in a cell of area 1
_DARTS = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(20)])


def _cells(weights: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, strip, cell) of the cells of area 1 that touch [0, weight) x [0, limit).

    Strip 0 covers weights 0 to 1, strip s those from 2 ** (s - 1) to 2 ** s; its cells are as
    much flatter as it is wider.
    """
    strips = np.where(weights <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64))
    element = np.repeat(np.arange(len(weights)), strips)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    cells = np.maximum(1, np.ceil(limit[element] * np.exp2(np.maximum(strip - 1, 0)))).astype(np.int64)
    which = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    return element[which], strip[which], cell


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, size: int, seed: int = 1) -> np.ndarray:
    """A row of ``size`` dart ids for each of ``sets`` weighted sets, 0 where a set is empty.

    ``elements`` (64-bit hashes, distinct within a set) belong to the set ``owner`` and have
    positive ``weights``. The rank limit is set to throw size * ln(size) + 2 * size darts at a set;
    sets that leave a coordinate empty are thrown at again up to twice the rank.
    """
    out = np.zeros((sets, size), np.uint64)
    total = np.bincount(owner, weights, minlength=sets)
    wanted = np.flatnonzero(total > 0)
    darts = size * math.log(size) + 2 * size
    while len(wanted):
        chosen = np.zeros(sets, bool)
        chosen[wanted] = True
        mine = chosen[owner]
        own, element, weight = owner[mine], elements[mine], weights[mine]
        limit = darts / total[own]
        at, strip, cell = _cells(weight, limit)
        width = np.exp2(np.maximum(strip - 1, 0))
        low = np.where(strip == 0, 0.0, width)
        key = mix(element[at] + mix((cell.astype(np.uint64) << np.uint64(6)) + strip.astype(np.uint64) + _GOLDEN * np.uint64(seed)))
        thrown = np.searchsorted(_DARTS, uniform(key), "right")
        dart = np.repeat(np.arange(len(at)), thrown)
        number = np.arange(len(dart)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        name = mix(key[dart] + (number + 1).astype(np.uint64) * _GOLDEN)
        place = mix(name)
        rank = (cell[dart] + uniform(name)) / width[dart]
        height = low[dart] + width[dart] * ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        hit = (height < weight[at[dart]]) & (rank < limit[at[dart]])
        name, rank = name[hit], rank[hit]
        slot = own[at[dart[hit]]] * size + ((place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        least = np.full(sets * size, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        full = np.zeros(sets * size, np.uint64)
        full[slot[first]] = name[first]
        full = full.reshape(sets, size)[wanted]
        out[wanted] = full
        wanted = wanted[(np.isinf(least).reshape(sets, size)[wanted]).any(axis=1)]
        darts *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band; the band's number is part of it."""
    cut = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1)), cut.shape[:2])
    for j in range(rows):
        key = mix(key * _GOLDEN + cut[:, :, j])
    return key


def _near(x, y, similar: float) -> Column:
    """Whether sets of these total weights can be a link; the lesser in the greater is the most."""
    return F.least(x, y) >= (similar - 1e-9) * F.greatest(x, y)


def _distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, window) in order of both, and how often each occurs."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return hashes[at], doc[at], np.diff(np.append(at, len(hashes)))


def _sign(bands: int, rows: int, width: int, weighted: bool, out: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            found = lower_ascii(texts(batch.column(2)))
            hashes, doc, times = _distinct(*word_windows(found, width))
            weights = times.astype(np.float64) if weighted else np.ones(len(doc))
            signatures = dart_signatures(hashes, weights, doc, len(found), bands * rows)
            keys = band_keys(signatures, bands, rows).astype(np.int64)
            some = np.bincount(doc, minlength=len(found)) > 0
            # two sums over a set's windows name the set
            named = mix(hashes + times.astype(np.uint64) * weighted)
            sums = [_sums(mix(named + np.uint64(k)), doc, len(found)) for k in (1, 2)]
            forms = np.stack(sums, 1).tobytes()
            form = [forms[16 * i : 16 * i + 16] if some[i] else None for i in range(len(found))]
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(some * bands)).astype(np.int32), keys[some].ravel())
            total = pa.array(np.bincount(doc, weights, minlength=len(found)).astype(np.int64))
            made = [*batch.columns[:2], pa.array(form, pa.binary()), lists, total, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(made, schema=out)

    return read


def _sums(values: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit integers by text, modulo 2 ** 64; ``doc`` ascends."""
    running = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
    edges = np.searchsorted(doc, np.arange(size + 1))
    return running[edges[1:]] - running[edges[:-1]]


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, weighted: bool = False, carried: list[str] | None = None) -> DataFrame:
    """uid, doc_id, form (equal for equal window sets), band keys, windows (total weight), text and ``row`` of each document.

    ``row`` is a struct of the columns ``carried`` and of whether the text was null.
    """
    row = F.struct(*(F.col(name) for name in carried or []), F.col("text").isNull().alias("_no_text_"))
    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), row.alias("row"))
    made = T._parse_datatype_string("form BINARY, bands ARRAY<LONG>, windows LONG")
    schema = T.StructType([*read.schema.fields[:2], *made, *read.schema.fields[2:]])
    return read.mapInArrow(_sign(bands, rows, width, weighted, to_arrow_schema(schema)), schema)


def _compare(width: int, weighted: bool):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def sets(batch: pa.RecordBatch, key: str, text: str) -> dict:
        """The window sets of the distinct texts of a column."""
        keys = np.asarray(batch.column(key))
        names, first = np.unique(keys, return_index=True)
        found = lower_ascii(texts(batch.column(text).take(pa.array(first))))
        hashes, doc, times = _distinct(*word_windows(found, width))
        edges = np.searchsorted(doc, np.arange(len(names) + 1))
        return {int(n): (hashes[x:y], times[x:y]) for n, x, y in zip(names, edges[:-1], edges[1:], strict=True)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(portions(batches, 2), 3):
            left, right = sets(batch, "a", "text_a"), sets(batch, "b", "text_b")
            similar = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                (x, m), (y, n) = left[a], right[b]
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                if weighted:
                    common, both = int(np.minimum(m[i], n[j]).sum()), int(m.sum() + n.sum())
                else:
                    common, both = len(i), len(x) + len(y)
                similar.append(common / (both - common))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], schema=out)

    return read


def _checked(pairs: DataFrame, texts_of: DataFrame, width: int, weighted: bool) -> DataFrame:
    """(a, b, similarity) of each pair, from the whole texts.

    The hints keep the plan the same at every size.
    """
    rows = pairs.join(texts_of.toDF("a", "text_a").hint("merge"), "a").join(texts_of.toDF("b", "text_b").hint("merge"), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_compare(width, weighted), "a LONG, b LONG, similarity DOUBLE")


def _ordered(one, other) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _among(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """The rows whose ``uid`` is one of ``uids``, read where they lie.

    Not a text is moved for it: a bit for each row of the table, as uids number rows, is gathered into maps
    of 4 KB and sent to the tasks. That is 2 MB for 16 million documents, or 4 KB for each partition if it has fewer than 32,768.
    """
    bits = uids.groupBy(F.bitmap_bucket_number("uid").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("uid")).alias("_bits"))
    place = F.bitmap_bit_position("uid")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_map", F.bitmap_bucket_number("uid")).join(F.broadcast(bits), "_map")
    return marked.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def linked(prepared: DataFrame, members: DataFrame, similar: float, width: int, weighted: bool) -> DataFrame:
    """(node, root): the classes of different texts that all links found in buckets make, as ``components`` gives them.

    ``members`` (bucket, uid, windows).
    """
    spark = prepared.sparkSession
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # hinted, so that the plan is the same at every size
    rows = join_single(members, buckets.hint("merge"), ["bucket"], "inner", spread=["uid"])
    meets = {"meets": F.sum("n").over(Window.partitionBy("uid"))}  # a text has a row for each band at most
    alone = {"class": F.col("uid"), "size": F.lit(1).cast("long"), "small": F.col("n") <= FIRST_FEW, "outside": F.lit(None).cast("boolean")}
    rows = land(rows.withColumns(meets | alone).select(*_MEMBER), "members")
    # only the texts that meet another one are moved
    met_texts = land(_among(prepared.select("uid", "text"), rows), "texts")
    tested = spark.createDataFrame([], "a LONG, b LONG, similarity DOUBLE")
    leaders = 1
    while True:
        many = land(rows.where("NOT small AND outside IS NULL").withColumn("buckets", _buckets()), "many")
        few = rows.where("small").groupBy("bucket").agg(F.collect_list(F.struct("uid", "class", "windows")).alias("u"))
        pairs = few.select(F.inline(_pairs("u", similar))).unionAll(_across(rows.where("outside IS NOT NULL"), similar))
        unsettled = bool(many.head(1))
        if unsettled:
            # the window's limit is applied before its shuffle: a few rows of a bucket from each task
            place = F.row_number().over(Window.partitionBy("bucket").orderBy("size", F.desc("meets"), "uid"))
            led = many.withColumn("_place", place).where(F.col("_place") <= leaders).withColumn("led_buckets", _buckets())
            led = land(led.select("bucket", *(F.col(name).alias("led_" + name) for name in ("uid", "class", "windows")), "led_buckets", "_place"), "leaders")
            # a pair is made in the first bucket that it shares and that it has a leader in
            once = F.try_element_at(F.array_intersect("led_buckets", "buckets"), F.lit(1)) == F.col("bucket")
            # the first leader's distances to all are wanted, so it meets everyone
            wanted = (F.col("_place") == 1) | _near("led_windows", "windows", similar)
            met = led.join(many, "bucket").where((F.col("class") != F.col("led_class")) & (F.col("uid") != F.col("led_uid")) & wanted & once)
            pairs = pairs.unionAll(met.select(*_ordered(F.col("led_uid"), F.col("uid"))))
        # distinct pairs that were not tested before
        pairs = pairs.withColumn("known", F.lit(False)).unionAll(tested.select("a", "b", F.lit(True).alias("known")))
        pairs = pairs.groupBy("a", "b").agg(F.max("known").alias("known")).where("NOT known").select("a", "b")
        tested = land(tested.unionAll(_checked(pairs, met_texts, width, weighted)), "tested")
        roots = components(tested.where(F.col("similarity") >= similar).select("a", "b"))
        if not unsettled:
            return roots
        left = _left_over(many, led.withColumnRenamed("led_uid", "leader"), tested, roots, similar)
        if not left.head(1):
            return roots
        met_texts = land(_among(met_texts, left), "texts")
        rows = rare_buckets(left, met_texts, tested, similar, width, weighted)
        leaders *= LEADERS


def _elements(width: int, weighted: bool):
    out = pa.schema([("uid", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            found = lower_ascii(texts(batch.column(1)))
            hashes, doc, times = _distinct(*word_windows(found, width))
            if weighted:  # each further copy of a window is an element of its own
                copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                hashes, doc = mix(np.repeat(hashes, times) + copy.astype(np.uint64) * _GOLDEN), np.repeat(doc, times)
            edges = np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(edges, hashes.astype(np.int64))], schema=out)

    return read


def rare_buckets(left: DataFrame, texts_of: DataFrame, tested: DataFrame, similar: float, width: int, weighted: bool) -> DataFrame:
    """The members again, in buckets that two of them share if their similarity is ``similar`` or more.

    ``texts_of`` are the texts of the members alone. ``outside`` is null but in large buckets that are done with all pairs of
    different classes: there it tells who is not of the largest class.
    A bucket is a window that two members have among their rarest, and the two classes of their sizes.
    Rarest are the windows of the fewest members; those of one member alone come first, and name no bucket.
    """
    members = left
    listed = texts_of.select("uid", "text").mapInArrow(_elements(width, weighted), "uid LONG, elements ARRAY<LONG>")
    elements = land(listed.select("uid", F.size("elements").cast("long").alias("windows"), F.explode("elements").alias("element")), "elements")
    of_sizes = elements.withColumn("step", F.floor(F.ln("windows") / math.log(SIZE_STEP) + 1e-9).cast("int"))
    # as many steps as there are orders of size: a short array
    shared = of_sizes.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.collect_set("step").alias("steps")).where("n > 1")
    common = join_single(of_sizes, shared, ["element"], "inner", spread=["uid"])
    own = Window.partitionBy("uid")
    alone = F.col("windows") - F.count(F.lit(1)).over(own)
    placed = common.withColumn("place", F.row_number().over(own.orderBy("n", "element")) + alone)

    def reaches(other: Column) -> Column:
        # of all sizes of that step, the least and the most that can be linked at all
        least = F.greatest(F.pow(F.lit(SIZE_STEP), other) - 1e-6, F.col("windows") * similar)
        possible = (F.pow(F.lit(SIZE_STEP), other + 1) + 1e-6) >= F.col("windows") * similar
        overlap = F.ceil((F.col("windows") + least) * (similar / (1 + similar)) - 1e-6)
        return possible & (least * similar <= F.col("windows") + 1e-6) & (F.col("place") <= F.col("windows") - overlap + 1)

    # no size asks for a longer prefix than the least that can be linked; only sizes in reach become rows
    placed = placed.where(F.col("place") <= F.col("windows") - F.ceil(F.col("windows") * similar - 1e-6) + 1)
    reached = placed.select("uid", "element", "step", F.explode(F.filter("steps", reaches)).alias("other"))
    bucket = F.xxhash64("element", F.array_sort(F.array("step", "other")))
    dealt = reached.select(bucket.alias("bucket"), "uid").join(members.select("uid", "class").hint("merge"), "uid")
    dealt = land(dealt, "dealt")
    counts = dealt.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    largest = F.max(F.struct("n", "class"))["class"].alias("largest")
    counts = counts.agg(F.sum("n").alias("n"), ((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("pairs"), largest).where("pairs > 0")
    # all pairs of different classes where they are in proportion to the texts
    whole = F.col("pairs") <= FEW * F.col("n")
    small = (F.col("n") <= FEW) | ((F.col("n") <= MIDDLING) & whole)
    dealt = join_single(dealt, counts.select("bucket", "n", small.alias("small"), F.when(whole & ~small, F.col("largest")).alias("largest")), ["bucket"], "inner", spread=["uid"])
    dealt = dealt.withColumn("outside", F.col("class") != F.col("largest"))
    # who was checked against many others does not lead again
    asked = [tested.select(F.col(end).alias("uid"), F.lit(-1).cast("long").alias("n"), F.lit(False).alias("dealt")) for end in ("a", "b")]
    totals = dealt.select("uid", "n", F.lit(True).alias("dealt")).unionAll(asked[0]).unionAll(asked[1]).groupBy("uid").agg(F.sum("n").alias("meets"), F.max("dealt").alias("dealt"))
    totals = totals.where("dealt").select("uid", "meets")
    members = join_single(members, members.groupBy("class").agg(F.count(F.lit(1)).alias("size")), ["class"], "inner", spread=["uid"]).join(totals, "uid")
    rows = dealt.select("bucket", "uid", "small", "outside").join(members.hint("merge"), "uid")
    return land(rows.select(*_MEMBER), "members")


def _buckets() -> Column:
    """All buckets of a row's text, in order: at most one for each band, or for each of its windows and sizes."""
    return F.sort_array(F.collect_set("bucket").over(Window.partitionBy("uid")))


_MEMBER = ["bucket", "uid", "windows", "meets", "class", "size", "small", "outside"]


def _across(rows: DataFrame, similar: float) -> DataFrame:
    """(a, b): the near pairs of different classes in buckets of any size, from those ``outside`` of a bucket's largest class."""
    apart = rows.where("outside").select("bucket", *(F.col(name).alias("led_" + name) for name in ("uid", "class", "windows")))
    once = ~F.col("outside") | (F.col("led_uid") < F.col("uid"))
    met = apart.join(rows, "bucket").where((F.col("class") != F.col("led_class")) & _near("led_windows", "windows", similar) & once)
    return met.select(*_ordered(F.col("led_uid"), F.col("uid")))


def _pairs(members: str, similar: float) -> Column:
    """The near pairs of an array of (uid, class, windows) with different classes."""

    def after(x, i):
        others = F.filter(F.slice(members, i + 2, F.size(members)), lambda y: (y["class"] != x["class"]) & _near(x["windows"], y["windows"], similar))
        return F.transform(others, lambda y: F.struct(*_ordered(x["uid"], y["uid"])))

    return F.flatten(F.transform(members, after))


def _left_over(many: DataFrame, led: DataFrame, tested: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """uid, windows and class of the members of large buckets between whose classes links may still be found.

    A leader has met all others. Two texts can only be linked if their distances to a bucket's first
    leader differ by at most the widest link, so a member of the bucket's largest class is done if that
    holds for nobody outside of it.
    """
    rows = many.select("bucket", "uid", "windows").join(roots.toDF("uid", "class"), "uid", "left").withColumn("class", F.coalesce("class", "uid"))
    # as many leaders as lead in this round
    leaders = led.groupBy("bucket").agg(F.min(F.struct("_place", "leader"))["leader"].alias("leader"), F.collect_set("leader").alias("leaders"))
    rows = rows.join(leaders, "bucket").where(~F.array_contains("leaders", F.col("uid"))).drop("leaders")
    rows = rows.withColumns({"a": F.least("leader", "uid"), "b": F.greatest("leader", "uid")}).join(tested, ["a", "b"], "left")
    # texts of the leader's class were not checked against it again: any distance is possible
    rows = land(rows.select("bucket", "uid", "windows", "class", (1 - F.col("similarity")).alias("far")), "judged")
    low, high = F.min(F.coalesce("far", F.lit(0.0))), F.max(F.coalesce("far", F.lit(1.0)))
    sizes = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("size"), low.alias("low"), high.alias("high"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "class"))["class"].alias("largest"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    outside = sizes.join(largest, "bucket").where("class != largest").groupBy("bucket", "largest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    widest = 1 - similar + 1e-9
    rows = join_single(rows, outside, ["bucket"], "inner", spread=["uid"])
    reach = (F.col("class") != F.col("largest")) | F.col("far").isNull() | F.col("far").between(F.col("low") - widest, F.col("high") + widest)
    left = rows.where(reach).groupBy("uid").agg(F.first("windows").alias("windows"), F.first("class").alias("class"))
    return land(left, "left-over")


def classes_of(prepared: DataFrame, similar: float = SIMILAR, width: int = WIDTH, weighted: bool = False) -> DataFrame:
    """uid, doc_id, class_id and ``kept`` (true for one row of each class) of the landed ``signed`` rows.

    class_id is the least doc_id of the class.
    """
    same = land(prepared.where("form IS NOT NULL").groupBy("form").agg(F.min("uid").alias("one")), "forms")
    single = _among(prepared.select("uid", "windows", "bands"), same.select(F.col("one").alias("uid")))
    members = single.select("uid", "windows", F.explode("bands").alias("bucket"))
    found = linked(prepared, members, similar, width, weighted)
    classed = prepared.select("uid", "doc_id", "form").join(same, "form", "left").withColumn("one", F.coalesce("one", "uid"))
    classed = classed.join(found.toDF("one", "root"), "one", "left")
    classed = land(classed.select("uid", "doc_id", F.coalesce("root", "one").alias("root")), "classed")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"]
    names = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), least.alias("first"))
    return join_single(classed, names, ["root"], "inner", spread=["uid"]).select("uid", "doc_id", "class_id", (F.col("uid") == F.col("first")).alias("kept"))


def near_duplicate_classes(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, weighted: bool = False) -> DataFrame:
    """uid, doc_id, class_id and kept of each row of ``docs``; uid numbers the rows."""
    return classes_of(land(signed(docs, bands, rows, width, weighted), "signed"), similar, width, weighted)


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, that of the least doc_id, with all columns."""
    others = [name for name in docs.columns if name != "text"]
    prepared = land(signed(docs, carried=others), "signed")
    kept = classes_of(prepared, similar).where("kept").select("uid")
    text = F.when(~F.col("row._no_text_"), F.col("text")).alias("text")
    return _among(prepared, kept).select(*(text if name == "text" else F.col("row")[name].alias(name) for name in docs.columns))
