"""Fuzzy line deduplication by MinHash, in DataFrame functions alone.

A line is lower-cased and its white space made single spaces. Its shingles are all its windows of WINDOW characters; a line of fewer
characters is one shingle. Of the shingles' hashes, SIGNATURE fixed points each take the nearest (by exclusive or), which makes the
MinHash signature; its values stand in a square whose rows, columns and diagonals are the bands. Lines that share a band are candidates,
the exact Jaccard similarity of their shingles decides, and distributed union-find makes components, of which one line stays.

No pair of lines that share a band is lost, however crowded the band. Lines of a crowd that are connected already don't meet again, and of
the others those meet that have a rare difference in common, label by label where the bounds of the labels allow a link; see _apart().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop, stage, texts
from pulsegrid.llm.components import components

WINDOW, SIDE, SIMILAR = 10, 3, 0.8
SIGNATURE = SIDE * SIDE
#: Rows, columns and diagonals of the square: no two bands have more than one value in common.
BANDS = [[SIDE * r + c for c in range(SIDE)] for r in range(SIDE)] + [[SIDE * r + c for r in range(SIDE)] for c in range(SIDE)] + [[SIDE * r + (r + d) % SIDE for r in range(SIDE)] for d in range(SIDE)]
#: Windows in a row while minima are made; parts of a line that are tried first.
STEP, PARTS = 8, 3
#: Members of a band that are each compared with so many others at most; the rest of a larger band meets through what differs.
FEW = 8
_ID_BITS = 62


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_lines, n, line): normalised lines; th is a hash of the whole text, n the line's number from 0 of n_lines.

    Lines without words are left out, but for the first of a text: each row of docs has one line 0.
    """
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), F.lower("text").alias("low"))
    odd = F.contains("low", F.lit("  ")) | F.contains("low", F.lit("\t")) | F.contains("low", F.lit("\r")) | F.contains("low", F.lit(" "))
    low = F.when(odd, F.regexp_replace("low", "[ \\t\\r\\f\\x0B ]+", " ")).otherwise(F.col("low"))
    rows = rows.select("doc_id", "th", F.split(low, "\n").alias("lines")).select("doc_id", "th", F.size("lines").cast("long").alias("n_lines"), "lines")
    # outer: else Spark splits every text a second time, to see whether there is a line at all
    rows = rows.select("doc_id", "th", "n_lines", F.posexplode_outer("lines").alias("n", "line"))
    return rows.select("doc_id", "th", "n_lines", "n", F.trim("line").alias("line")).where("line <> '' or n = 0")


def _staged(docs: DataFrame) -> tuple[DataFrame, str]:
    """lines_of(docs), written, and where, with a line's id and a second hash, other; lines without words have no id."""
    words = F.when(F.col("line") != "", F.shiftrightunsigned(F.xxhash64("line"), 64 - _ID_BITS))
    return stage(lines_of(docs).select("doc_id", "th", "n_lines", "n", words.alias("id"), F.hash("line").alias("other"), "line"), "lines")


def _wide(line: Column) -> Column:
    """Two bytes for each character (two characters for one outside the basic plane), so that a window is found without a search."""
    return F.encode(line, "UTF-16BE")


def _last(wide: Column) -> Column:
    """The number of the last window, from 0."""
    return F.greatest((F.octet_length(wide) / 2).cast("int") - WINDOW, F.lit(0))


def _window(wide: Column, at: Column) -> Column:
    """The window that begins at a byte, from 1."""
    return F.call_function("substring", wide, at, F.lit(2 * WINDOW))


def shingles(line: Column) -> Column:
    """Distinct 64-bit hashes of a normalised line's shingles."""
    return F.array_distinct(F.element_at(F.transform(F.array(_wide(line)), lambda w: F.transform(F.sequence(F.lit(1), _last(w) * 2 + 1, F.lit(2)), lambda at: F.xxhash64(_window(w, at)))), 1))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, n, m0, m1, ...) for each distinct line: how often it stands and its signature. lines: id, line.

    The windows are rows, STEP to a row, only within a task: their minima are combined there, and a row for each line and task is shuffled.
    """
    wide = lines.select("id", _wide(F.col("line")).alias("w")).withColumn("last", _last(F.col("w")))
    runs = wide.select("id", "w", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    hashes = [F.hash(_window(F.col("w"), F.least(F.col("i") + j, F.col("last")) * 2 + 1)).alias(f"h{j}") for j in range(STEP)]
    points = [(k << 32) // SIGNATURE - (1 << 31) for k in range(SIGNATURE)]
    least = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(p)) for j in range(STEP)])).alias(f"m{k}") for k, p in enumerate(points)]
    return runs.select("id", "i", *hashes).groupBy("id").agg(F.count_if(F.col("i") == 0).alias("n"), *least)


def with_nodes(signed: DataFrame) -> DataFrame:
    """Adds node, the id with the line's frequency, in four steps, above it: in a band, the least node is a line that stands often."""
    step = F.when(F.col("n") >= 16, -2).when(F.col("n") >= 4, -1).when(F.col("n") >= 2, 0).otherwise(1).cast("long")
    return signed.withColumn("node", step * F.lit(1 << _ID_BITS) + F.col("id"))


def id_of(node: Column) -> Column:
    return node.bitwiseAND(F.lit((1 << _ID_BITS) - 1))


def band_keys(signed: DataFrame) -> DataFrame:
    """(key, node): a row for each band of each line."""
    return signed.select("node", F.explode(F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in band]) for b, band in enumerate(BANDS)])).alias("key"))


def compared(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The columns of pairs (a, b, ...), na, nb, common: sizes of their shingle sets and of what is in both. lines: node, line."""
    a, b = lines.select(F.col("node").alias("a"), F.col("line").alias("la")), lines.select(F.col("node").alias("b"), F.col("line").alias("lb"))
    sets = pairs.join(a, "a").join(b, "b").select(*pairs.columns, shingles(F.col("la")).alias("sa"), shingles(F.col("lb")).alias("sb"))
    return sets.select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def _meets(threshold: float) -> Column:
    return F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9


def links(bands: DataFrame, lines: DataFrame, threshold: float = SIMILAR) -> tuple[DataFrame, str]:
    """(a, b), written, and where: pairs that connect all lines which share a band and are similar, by verified links. bands: key, node; lines: id, line.

    Each member of a band is compared with one of it, the pivot, which most bands of a crowd have in common. Members that link
    with the pivot are connected. What the others may link with is found
    - in a band of up to FEW members by comparing them with the rest of it,
    - in a larger one through the sets in which members differ from the pivot; see _differences().
    """
    pivot = F.min("node").over(Window.partitionBy("key"))
    members, members_path = stage(bands.select("key", pivot.alias("a"), F.col("node").alias("b")).where("a <> b"), "line-bands")
    nodes = members.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # copies of a line go where they stand, before any line is shuffled
    held = lines.dropDuplicates(["id"]).join(nodes.select(id_of(F.col("node")).alias("id"), "node"), "id").select("node", "line")
    held, held_path = stage(held, "line-texts")
    met, met_path = stage(compared(members.select("a", "b").distinct(), held), "line-pivots")
    met = met.withColumn("linked", _meets(threshold))
    found = met.where("linked").select("a", "b")

    # bands with a member that doesn't link with the pivot and another besides; n counts members without the pivot
    some = members.join(met.select("a", "b", "linked"), ["a", "b"])
    loose = some.groupBy("key").agg(F.bool_and("linked").alias("done"), F.count("*").alias("n")).where("not done and n > 1").select("key", "n")
    some, some_path = stage(some.join(loose, "key").select("key", "a", "b", "n", "linked"), "line-loose", members_path)
    few = some.where(F.col("n") < FEW)
    x, y = (few.select("key", F.col("b").alias(c), F.col("linked").alias(f"l{c}")) for c in "ab")
    direct = x.join(y, "key").where("a < b and not (la and lb)").select("a", "b")
    crowded = some.where(F.col("n") >= FEW).select("a", "b").distinct()
    apart, apart_path = _differences(crowded.join(met, ["a", "b"]), held, threshold)
    # what a line of a crowd most likely links with; lines that are connected by now need not be compared
    tried, tried_path = stage(compared(direct.union(_likely(apart)).distinct(), held).where(_meets(threshold)).select("a", "b").union(found), "line-links", met_path)
    labels = components(tried, name="line-labels")
    left, left_paths = _apart(crowded, apart, labels, threshold)
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    if left is not None:
        known = known.union(compared(left, held).where(_meets(threshold)).select("a", "b"))
    return stage(known, "line-links", held_path, apart_path, tried_path, some_path, *left_paths)


def _differences(crowd: DataFrame, lines: DataFrame, threshold: float) -> tuple[DataFrame, str]:
    """(pivot, b, linked, size, all, own, other, c, s, w, at), written, and where: the sets D(b) in which lines differ from their pivot, in parts.

    crowd: a (the pivot), b, na, nb, common, linked. Lines x and y differ in as much as D(x) and D(y) do: similar to t means that D(x) and D(y)
    differ in r (|x| + |y|) members at most, r = (1 - t) / (1 + t). Where x doesn't link, |D(x)| > r (|x| + |pivot|). So D(x) and D(y)
    share |D(x)| - r (|x| + |y|) members at least, and also (|D(y)| + r (|pivot| - |y|)) / 2. With the members of a crowd's differences
    ordered by how many lines have them, rarest first, x and y meet among the first `own` of D(x) and the first `other` of D(y).
    What all lines share with the pivot is in no difference, and what one line alone has meets nothing: hardly a pair is made in vain.
    Members that the same c lines have are one part s of weight w; at is the weight before it; size is |b|, all is |D(b)|.
    """
    r = (1 - threshold) / (1 + threshold)
    a, b = lines.select(F.col("node").alias("a"), F.col("line").alias("la")), lines.select(F.col("node").alias("b"), F.col("line").alias("lb"))
    sets = crowd.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "linked", shingles(F.col("la")).alias("sa"), shingles(F.col("lb")).alias("sb"))
    # outer: else Spark makes every set a second time, to see whether it is empty
    terms = sets.select(F.col("a").alias("pivot"), "b", "na", "nb", "linked", F.explode_outer(F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))).alias("t")).where("t is not null")
    same = Window.partitionBy("t", "pivot")
    parts = terms.select("pivot", "b", "na", "nb", "linked", F.count("*").over(same).alias("c"), F.expr("bit_xor(xxhash64(b))").over(same).alias("s"))
    parts = parts.groupBy("pivot", "b", "na", "nb", "linked", "c", "s").agg(F.count("*").alias("w"))
    line = Window.partitionBy("pivot", "b")
    parts = parts.withColumn("all", F.sum("w").over(line)).withColumn("at", F.sum("w").over(line.orderBy("c", "s")) - F.col("w"))
    own = F.when(~F.col("linked"), F.floor(r * F.col("nb") * (1 + 1 / threshold) + 1e-6) + 1)
    other = F.greatest(F.col("all") - F.ceil((F.col("all") + r * (F.col("na") - F.col("nb"))) / 2 - 1e-6) + 1, F.lit(1))
    parts = parts.where("c > 1").select("pivot", "b", "linked", F.col("nb").alias("size"), "all", own.alias("own"), other.alias("other"), "c", "s", "w", "at")
    parts = parts.where(F.col("at") < F.greatest(F.coalesce("own", F.lit(0)), "other"))
    return stage(parts, "line-differences")


def _likely(apart: DataFrame) -> DataFrame:
    """(a, b): for each line the one that differs least from the pivot among those that have one of its PARTS rarest parts too."""
    near = apart.groupBy("pivot", "s").agg(F.min(F.struct("all", "b")).alias("near"))
    rare = apart.withColumn("place", F.row_number().over(Window.partitionBy("pivot", "b").orderBy("at"))).where(F.col("place") <= PARTS)
    met = rare.select("pivot", "s", F.col("b").alias("x")).join(near, ["pivot", "s"]).where("near.b <> x")
    return met.select(F.least("x", "near.b").alias("a"), F.greatest("x", "near.b").alias("b")).distinct()


def _bounded(apart: DataFrame, threshold: float) -> DataFrame:
    """apart with bounds low and high of what each line may link with, and whether the part lies within the first `own` or the first `other`.

    From the first part that two lines have in common on, both have at most what is left of their differences, so rest(x) and rest(y) are
    (|D(x)| + |D(y)| - r (|x| + |y|)) / 2 or more. With low = |D| - r |line| and high = 2 rest - low that is: low(x) <= high(y) and low(y) <= high(x).
    """
    r = (1 - threshold) / (1 + threshold)
    low = F.col("all") - r * F.col("size")
    high = 2 * (F.col("all") - F.col("at")) - low
    return apart.select("pivot", "s", "label", "b", low.alias("low"), high.alias("high"), F.col("size").alias("small"), F.col("size").alias("large"), F.coalesce(F.col("at") < F.col("own"), F.lit(False)).alias("as_x"), (F.col("at") < F.col("other")).alias("as_y"))


def _meeting(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """The rows of x and y, as structs x and y, that agree in `on`."""
    x, y = (side.select(*on, F.struct(*[c for c in side.columns if c not in on]).alias(name)) for side, name in ((x, "x"), (y, "y")))
    return x.join(y, on)


def _met(x: DataFrame, y: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """Of what meets, the rows whose bounds and sizes allow a link."""
    room = (F.col("x.low") <= F.col("y.high") + 1e-6) & (F.col("y.low") <= F.col("x.high") + 1e-6)
    sizes = (F.col("x.large") >= threshold * F.col("y.small") - 1e-6) & (F.col("y.large") >= threshold * F.col("x.small") - 1e-6)
    return _meeting(x, y, on).where(room & sizes)


def _label_pairs(bounded: DataFrame, threshold: float) -> DataFrame:
    """(pivot, s, label, other): labels that have a part in common and whose lines' bounds, taken together, allow a link.

    A part that the lines of one label alone have, as nearly all of a crowd's parts, meets nothing.
    """
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("small").alias("small"), F.max("large").alias("large")]
    x, y = (bounded.where(side).groupBy("pivot", "s", "label").agg(*ends) for side in ("as_x", "as_y"))
    met = _met(x, y, ["pivot", "s"], threshold).where("x.label <> y.label")
    return met.select("pivot", "s", F.col("x.label").alias("label"), F.col("y.label").alias("other"))


def _apart(crowd: DataFrame, apart: DataFrame, labels: DataFrame, threshold: float) -> tuple[DataFrame | None, list[str]]:
    """(a, b), and what was written for it: all pairs of different labels that may link, of which one at least doesn't link with the pivot.

    crowd: a (the pivot), b; apart: as from _differences(); labels: node, component. Crowds that are connected by now have nothing to compare:
    there is no frame where all are.
    """
    named = labels.select(F.col("node").alias("b"), F.col("component").alias("label"))
    label = F.coalesce("label", "b")
    mixed = crowd.join(named, "b", "left").groupBy(F.col("a").alias("pivot")).agg(F.min(label).alias("least"), F.max(label).alias("most")).where("least < most").select("pivot")
    mixed, mixed_path = stage(mixed, "line-mixed")
    if mixed.isEmpty():
        return None, [mixed_path]
    open_ = apart.join(mixed, "pivot", "left_semi").join(named, "b", "left").withColumn("label", label)
    bounded, path = stage(_bounded(open_, threshold), "line-bounds")
    own = bounded.where("as_x").drop("as_x", "as_y").join(_label_pairs(bounded, threshold), ["pivot", "s", "label"])
    met = _met(own, bounded.where("as_y").drop("as_x", "as_y").withColumnRenamed("label", "other"), ["pivot", "s", "other"], threshold)
    return met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct(), [mixed_path, path]


def repeats(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(doc_id, th, n, line_id, component_id, kept): the lines that have an equal or similar one. One line of each component is kept.

    docs: doc_id, text. A line's id is its 62-bit hash; a component's is one of its lines'. Kept is the line that comes first by doc_id (null
    first), hash of the text, number. Rows of one doc_id and text count as one document. Lines without words are never listed.
    Lines of one id count as equal where a second hash agrees; else none of them is listed.
    """
    return _repeats(*_staged(docs), threshold)


def _repeats(own: DataFrame, own_path: str, threshold: float) -> DataFrame:
    """repeats() of lines as from _staged(), which go."""
    own = own.where("id is not null")
    signed, signed_path = stage(signatures(own.select("id", "line")), "line-signatures")
    signed = with_nodes(signed)
    found, found_path = links(band_keys(signed), own.select("id", "line"), threshold)
    named = components(found, name="line-components")
    drop(found.sparkSession, found_path)
    again = signed.where("n > 1").select("node").join(named, "node", "full").select(id_of(F.col("node")).alias("id"), F.coalesce("component", "node").alias("component_id"))
    places = own.select("doc_id", "th", "n", "id", "other").join(again, "id")
    places, _ = stage(places.select("doc_id", "th", "n", F.col("id").alias("line_id"), "other", "component_id"), "line-places", own_path, signed_path)
    # an id that two texts have is neither's; hardly ever is there one, and then no line need be dealt out for it
    shared = places.groupBy("line_id").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("line_id")
    if not shared.isEmpty():
        places = places.join(shared, "line_id", "left_anti")
    place = F.struct("doc_id", "th", "n")
    first = places.groupBy("component_id").agg(F.min(place).alias("first"))
    return places.join(first, "component_id").select("doc_id", "th", "n", "line_id", "component_id", (place == F.col("first")).alias("kept"))


def _dropped(own: DataFrame, own_path: str, threshold: float) -> DataFrame:
    gone = _repeats(own, own_path, threshold).where("not kept").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("n")).alias("gone"))
    return stage(gone, "line-gone")[0]


def line_counts(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (numbers of the lines that go, from 0, comma-joined) for each row. docs are read once."""
    own, own_path = _staged(docs)
    rows, _ = stage(own.where("n = 0").select("doc_id", "th", "n_lines"), "line-texts")
    gone = _dropped(own, own_path, threshold)
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th"))
    out = rows.alias("l").join(gone.alias("r"), same, "left")
    return out.select("l.doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("dropped"))


def dedup(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """docs, all rows and columns, with the repeated lines gone from text; a null text stays null, a text may become empty.

    Lines without words stay. Columns of any names pass through; an empty table gives no rows.
    """
    gone = _dropped(*_staged(docs), threshold)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("i"), F.xxhash64(text).alias("th"))
    same = F.col("l.i").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th"))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return rows.alias("l").join(gone.alias("r"), same, "left").select(*[new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
