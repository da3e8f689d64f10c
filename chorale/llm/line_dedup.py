"""Line deduplication across a corpus, by a segment-partition edit join, in DataFrame operations only.

Lines of at least MIN_CHARS characters are near-equal within EDITS edits; shorter ones only if equal. A line cut
into EDITS + 1 segments of even length leaves at least one untouched by so many edits. So each distinct line is
indexed under its segments, by length and position, and probes the index for its own length and the EDITS
lengths below with those of its substrings whose position such edits can reach. A segment that very many lines
share names little: there the rest of the line, which may hold no more edits, is cut into segments again, and lines
meet under both: first each with the earliest one there, then those that aren't decided by that with all. The counts of candidates' letters must not differ by more than two an edit; what remains is verified
by a bit-parallel automaton in the band around the diagonal. Lines of the last kind are measured as they meet, so that
only near-equal ones make a row.

A line is removed if an equal or near-equal line stands earlier, by doc_id, text (rows of one doc_id with other
texts are other documents, in the order of a hash) and line number, whether or not that one stays itself. Lines
without a word are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, stored

EDITS, MIN_CHARS = 2, 24
#: The sixteen characters by whose counts candidates are compared.
LETTERS = "etaoinshrldu cm."
#: Line hashes up to which a list is sent to all tasks (some 30 bytes each); beyond, it is joined by a shuffle.
BROADCAST_LINES = 300_000
#: One distinct line in so many tells which segments are common: those that so many of these lines have.
GLANCE, COMMON = 4, 4


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(start from 0, length) of a line's i-th segment; the last ones take the remainder."""
    short, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = i - (parts - longer)
    return i * short + F.greatest(extra, F.lit(0)), short + (extra >= 0).cast("int")


def _pieces(n: Column, edits: int) -> list[tuple[int, int, Column, Column]]:
    """(characters that the other line is shorter by, segment, start, size) of the substrings that a line of n characters meets others by; the first
    edits + 1 are its own segments."""
    own, others = [], []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            start, size = _segment(n - shorter, i, edits + 1)
            for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                (own if shorter == move == 0 else others).append((shorter, i, start + move, size))
    return own + others


def _keys(line: Column, n: Column, edits: int, only: int | None = None) -> Column:
    """Of a line in UTF-32, so that a substring is a slice of bytes; all, or those by which it meets lines shorter by so many characters."""
    return F.array(*(F.xxhash64((n - shorter).cast("int"), F.lit(i), F.substring(line, 4 * start + 1, 4 * size)) for shorter, i, start, size in _pieces(n, edits) if only in (None, shorter)))


def _keyed(df: DataFrame, line: str, edits: int, *kept: str) -> DataFrame:
    """(kept, keys) of each row's line."""
    wide = df.select(*kept, F.encode(line, "UTF-32").alias("__line"))
    return wide.select(*kept, _keys(F.col("__line"), (F.octet_length("__line") / 4).cast("int"), edits).alias("keys"))


def _letters(line: Column) -> Column:
    """The counts of LETTERS, up to 255 each, as the bytes of two integers."""
    counts = [F.least(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("long") for c in LETTERS]
    whole = lambda some: reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(c, 8 * k) for k, c in enumerate(some)))
    return F.struct(whole(counts[:8]).alias("x"), whole(counts[8:]).alias("y"))


def _letters_apart(a: str, b: str) -> Column:
    """The sum of the counts' differences: an edit changes two counts by one at most."""
    count = lambda x, half, k: F.shiftright(F.col(f"{x}.{half}"), 8 * k).bitwiseAND(F.lit(255))
    return reduce(lambda x, y: x + y, (F.abs(count(a, half, k) - count(b, half, k)) for half in "xy" for k in range(8)))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within so many edits of characters.

    For each number of edits e a word of 2 * edits + 1 bits holds the diagonals of the band that e edits can reach; all
    words are one integer. A character of b moves them at once: along the diagonals where a has the same character, and
    with one edit more along it (another character), to the one below (one more in b) or above (one more in a).
    """
    if edits > 4:
        raise ValueError("at most 4 edits: the band's bits must fit one integer")
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")

    def step(state: Column, equal: Column) -> Column:
        old = [F.shiftright(state, e * width).bitwiseAND(full) for e in range(edits + 1)]
        new = [old[0].bitwiseAND(equal)]
        for e in range(1, edits + 1):
            reached = old[e].bitwiseAND(equal).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
            new.append(reached.bitwiseAND(full))
        return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(x, e * width) for e, x in enumerate(new)))

    def equals(x: Column) -> Column:
        """For each character of b the diagonals of the band on which a has it."""
        same = lambda c, j: reduce(lambda u, v: u + v, (F.get(x["a"], j + d).eqNullSafe(c).cast("long") * (1 << (d + edits)) for d in range(-edits, edits + 1)))
        return F.transform(x["b"], same)

    start = sum(((1 << (e + 1)) - 1) << (edits + e * width) for e in range(edits + 1))
    n, m = F.char_length(a), F.char_length(b)
    # The characters are bound to a variable, or each step would split the texts anew.
    characters = F.array(F.struct(F.split(a, "").alias("a"), F.when(m > 0, F.split(b, "")).otherwise(F.array().cast("array<string>")).alias("b")))
    last = F.get(F.transform(characters, lambda x: F.aggregate(equals(x), F.lit(start).cast("long"), step)), F.lit(0))
    return (F.abs(n - m) <= edits) & (F.call_function("shiftright", last, edits * width + edits + n - m).bitwiseAND(F.lit(1)) == 1)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no from 0, line, h) of the lines with a word; rows with a null id have none."""
    own = documents(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    split = own.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _listed(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_LINES else hashes


def _meeting(index: DataFrame, probe: DataFrame, edits: int | None = None, both: bool = False) -> DataFrame:
    """(a, b), a < b: different lines under one key, and with edits only those within so many; some more than once.

    both: index holds the probe's own rows, so two of those would meet from either side, and need but one.
    """
    kept = [] if edits is None else ["letters", "own", "line"]
    one, other = (d.select("key", F.col("h").alias(x), *(F.col(c).alias(c + x) for c in kept)) for d, x in ((index, "x"), (probe, "y")))
    alike = F.col("x") != F.col("y")
    if edits is not None:
        alike &= _letters_apart("lettersx", "lettersy") <= 2 * edits
    if both:
        alike &= ~F.col("owny") | (F.col("x") < F.col("y"))
    if edits is not None:  # the dearest test comes last; beyond so many edits it gives -1
        alike &= F.levenshtein("linex", "liney", edits) >= 0
    return one.join(other, (one["key"] == other["key"]) & alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _common(keyed: DataFrame, edits: int) -> DataFrame:
    """Keys of segments that very many lines share, told from some of the lines; what is told decides how lines meet, never whether."""
    some = keyed.where(F.pmod("h", F.lit(GLANCE)) == 0)
    return stored(some.select(F.explode(F.slice("keys", 1, edits + 1)).alias("key")).groupBy("key").count().where(F.col("count") >= COMMON).select("key"), "common")


def _deeper(hot_lines: DataFrame, common: DataFrame, edits: int) -> DataFrame:
    """(key, h, first, letters, line, own) of lines(h, line, first, letters) under their common keys and the segments of what each leaves of the line; own: in the index, too.

    A common key holds the length of the line in the index, so what both leave differs in length by as much as the lines do: inner
    substrings for other differences meet nothing and aren't made.
    """
    kept = ["h", "first", "letters", "line"]
    n = (F.octet_length("wide") / 4).cast("int")
    wide = hot_lines.select(*kept, F.encode("line", "UTF-32").alias("wide"))
    piece = F.array(*(F.struct(F.lit(k).alias("was"), F.lit(shorter).alias("shorter"), (4 * start).alias("start"), (4 * size).alias("size")) for k, (shorter, _, start, size) in enumerate(_pieces(n, edits))))
    each = wide.select(*kept, "wide", piece.alias("pieces"), _keys(F.col("wide"), n, edits).alias("keys")).select(*kept, "wide", F.posexplode("keys").alias("k", "outer"), "pieces")
    shared = each.join(common.withColumnRenamed("key", "outer"), "outer").select(*kept, "wide", "outer", F.get("pieces", F.col("k")).alias("p"))
    rest = F.concat(F.substring("wide", F.lit(1), F.col("p.start")), F.substring("wide", F.col("p.start") + F.col("p.size") + 1, F.octet_length("wide")))
    left = shared.select(*kept, "outer", "p.was", "p.shorter", rest.alias("wide"))
    inner = F.coalesce(*(F.when(F.col("shorter") == s, _keys(F.col("wide"), n, edits, s)) for s in range(edits + 1)))
    again = left.select(*kept, "outer", "was", F.posexplode(inner).alias("at", "inner"))
    return again.select(F.xxhash64("outer", "inner").alias("key"), *kept, ((F.col("was") <= edits) & (F.col("at") <= edits)).alias("own")).distinct()


def _verified(pairs: DataFrame, texts, edits: int) -> DataFrame:
    """The distinct pairs (a, b) of lines within `edits` edits; texts gives (h, line) of the wanted ones."""
    pairs = stored(pairs.distinct(), "line-pairs")
    wanted = _listed(stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines"))
    known = stored(texts(wanted).withColumn("letters", _letters(F.col("line"))), "lines")
    side = lambda x: known.select(F.col("h").alias(x), F.col("line").alias(f"l{x}"), F.col("letters").alias(f"c{x}"))
    alike = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(_letters_apart("ca", "cb") <= 2 * edits).drop("ca", "cb"), "line-pairs")
    return stored(alike.where(within(F.col("la"), F.col("lb"), edits)).select("a", "b"), "near-lines")


def _later(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h): the line of each pair whose first place is the later one."""
    wanted = _listed(stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines"))
    begin = stored(firsts.join(wanted, "h", "left_semi").select("h", "first"), "firsts")
    side = lambda x: begin.select(F.col("h").alias(x), F.col("first").alias(f"f{x}"))
    chosen = F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(chosen.alias("h")).distinct()


def near_lines(every: DataFrame, firsts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h): lines that have a near-equal one with an earlier first place; every: lines(), firsts(h, first)."""
    long_lines = every.where(F.char_length("line") >= min_chars)
    keyed = stored(_keyed(long_lines, "line", edits, "h").groupBy("h").agg(F.first("keys").alias("keys")), "keyed")
    rows = keyed.select("h", F.posexplode("keys").alias("at", "key"))
    common = _common(keyed, edits)
    texts = lambda wanted: long_lines.select("h", "line").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    if not common.limit(1).count():
        return _later(_verified(_meeting(rows.where(F.col("at") <= edits), rows), texts, edits), firsts)

    hot = _listed(common)
    who = _listed(stored(rows.join(hot, "key", "left_semi").select("h").distinct(), "lines"))
    hot_lines = stored(texts(who).join(firsts.select("h", "first"), "h").withColumn("letters", _letters(F.col("line"))), "hot-lines")
    deep = stored(_deeper(hot_lines, hot, edits), "deeper")
    index = deep.where("own")
    centres = stored(index.groupBy("key").agg(F.min(F.struct("first", "h")).alias("c")), "centres")
    star = index.join(centres, "key").where("first > c.first").select(F.least("h", "c.h").alias("a"), F.greatest("h", "c.h").alias("b"))
    decided = stored(_later(_verified(star, texts, edits), firsts), "near-lines")
    open_, closed = (deep.join(_listed(decided), "h", how) for how in ("left_anti", "left_semi"))
    still = _meeting(open_.where("own"), open_, edits, both=True).unionByName(_meeting(closed.where("own"), open_, edits)).unionByName(_meeting(open_.where("own"), closed, edits))
    cold = rows.join(hot, "key", "left_anti")
    others = _verified(_meeting(cold.where(F.col("at") <= edits), cold), texts, edits).unionByName(stored(still.distinct(), "near-lines"))
    return decided.unionByName(_later(others, firsts)).distinct()


def _removed(docs: DataFrame, edits: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, line_no, near), a row for each row's removed line."""
    every = lines(docs, id_col, text_col)
    place = F.struct("doc_id", "text_key", "line_no")
    firsts = stored(every.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    later = _listed(stored(near_lines(every, firsts, edits, min_chars).withColumn("near", F.lit(True)), "near-lines"))
    decided = firsts.join(later, "h", "left").where("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # A list, or a plain join of two tables: a line that stands in very many places isn't one task's.
    found = every.join(_listed(stored(decided, "decided")), "h").withColumn("is_first", place == F.col("first"))
    return found.where("near or not is_first").select("doc_id", "text_key", "line_no", (F.col("near") & F.col("is_first")).alias("near"))


def _gone(docs: DataFrame, edits: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __key, __gone array<struct<line_no, near>>): the removed lines of each document."""
    removed = _removed(docs, edits, min_chars, id_col, text_col)
    return removed.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("line_no", "near")).alias("__gone"))


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no, near): lines to remove; near: no equal line stands earlier, only a near-equal one. text_key: a hash that tells texts of one doc_id apart."""
    return _removed(docs, edits, min_chars, id_col, text_col).distinct()


def summary(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_near, kept_lines) of each row: its lines, those equal to an earlier one, and those only near-equal to one.

    A null text has no lines; an empty one has one, which stays. Rows of one doc_id and text count as one document, whose
    equal places are one place; a null doc_id loses nothing. An empty table gives an empty one.
    """
    own = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), F.greatest(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    gone = _gone(docs, edits, min_chars, id_col, text_col)
    near = F.coalesce(F.size(F.filter("__gone", lambda x: x["near"])), F.lit(0)).cast("long")
    every = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    joined = own.join(gone, (own["doc_id"] == gone["__id"]) & (own["key"] == gone["__key"]), "left")
    return joined.select("doc_id", "n_lines", (every - near).alias("n_repeated"), near.alias("n_near"), (F.col("n_lines") - every).alias("kept_lines"))


def deduplicated(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of the table, with the removed lines taken out of the text.

    A text of which nothing stays is empty; null stays null. Rows of one doc_id with different texts lose their own
    lines only; a row with a null doc_id loses none.
    """
    gone = _gone(docs, edits, min_chars, id_col, text_col)
    at = F.array_sort(F.transform("__gone", lambda x: x["line_no"]))
    # A text of 0 and 1 for each line, as bytes: one look for each line, however many go.
    marks = F.zip_with(at, F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1)), lambda x, before: F.concat(F.repeat(F.lit("0"), x - before - 1), F.lit("1")))
    mask = F.array_join(marks, "").cast("binary")
    text = F.col(f"__row.`{text_col}`")
    kept = F.filter(F.split(text, "\n"), lambda _, k: F.substring("__mask", k + 1, F.lit(1)) != F.lit(b"1"))
    left = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    # The row travels as one column, so that none of its names meets one of these.
    rows = docs.select(docs[id_col].cast("long").alias("__doc"), F.xxhash64(docs[text_col].cast("string")).alias("__text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    joined = rows.join(gone, (F.col("__doc") == F.col("__id")) & (F.col("__text") == F.col("__key")), "left").withColumn("__mask", mask)
    return joined.select(*((left if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))
