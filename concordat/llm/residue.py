"""Documents that hold template residue: slots never filled, filler text, error pages and notices that scripts are needed.

No wording is given beforehand; everything is learnt from the corpus in three steps.

1. Slots. Marked pieces of text (``{{x}}``, ``[x]``, ``%x%`` and the like) are lifted out; a name that
   stands in marks of several kinds is a variable's name, as templates of one meaning differ in their marks.
2. Templates. With these names and all numbers lifted, texts that stem from one template agree word by word.
   Overlapping windows of three words align them, whatever stands before and behind. A window is a template's
   where a notable share of the documents that hold it are whole short pages: an error page, a notice or a
   layout's filler stands as a page of its own again and again, a sentence of real content hardly ever does.
   The same test on single words finds filler drawn from an invented vocabulary.
   A word or two beside which only variables' names stand border a slot as well ("insert _", "_ missing").
3. Finds. A document has residue where a known name is left in marks or in such a slot, where windows of
   templates follow each other over a whole sentence or far enough, or where several words of pure filler do.

Lines that only ever lead or close a page (menus, footers) accompany templates but are none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.runtime import cut_lineage

#: Marks that templates put around the names of their slots, each with what closes it.
MARKS = {
    "{{": "}}", "{{{": "}}}", "${": "}", "#{": "}", "<%": "%>", "<%=": "%>", "<%-": "%>", "{%": "%}", "@@": "@@", "%(": ")s", "[[": "]]", "<<": ">>",
    "__": "__", "%": "%", "{": "}", "[": "]", "<": ">",
}
#: What opens, a name, what closes; every match begins with one of a few signs, which is what makes the search fast.
_SLOT = re.compile(r"([{$#<%@\[_][{<%@\[_(=\-]{0,2})\s*([^\s{}\[\]<>%@()$#=+*/\\^|,;:!?\"'&~_][^{}\[\]<>%@()$#=+*/\\^|,;:!?\"'&~]{1,40}?)\s*(\}{2,3}|%>|%\}|\)s|\]\]|>>|__|@@|[%}\]>])")
_BETWEEN = re.compile(r"[\s_.\-]+")
_DIGITS = re.compile(r"\d+")
#: A word, a line break, a number, a time mark, or a mark that ends or encloses a sentence.
_TOKEN = re.compile("[^\\s!-@\\[-`{-~।…«»“”„·–—©←→¿¡\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f]+|\n|\\d+(?:[.,]\\d+)*|\\[\\d\\d:\\d\\d\\]|[.!?:;|।()\\[\\]{}<>%@]")
#: Signs that are in a text but not seen: zero width, soft hyphen, byte order mark.
_UNSEEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f]")
_SKIP, _LINE, _STOP, _COLON, _NUMBER, _NAME = range(6)


def _word_id(word: str) -> int:
    if word == "\n":
        return _LINE
    if word == ":":
        return _COLON
    if word[0] == "[" and len(word) > 1:
        return _SKIP
    if word[0].isdigit():
        return _NUMBER
    if len(word) == 1 and word in ".!?;|।()[]{}<>%@":
        return _STOP
    return xxhash.xxh64_intdigest(word) >> 1 | 64


class _Ids(dict):
    """Words seen so far with their numbers."""

    def __missing__(self, word: str) -> int:
        self[word] = number = _word_id(word)
        return number


def _readable(text: str) -> str:
    text = text.strip().lower()
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return html.unescape(text) if "&" in text else text


def slot_names(text: str) -> set[tuple[str, str]]:
    """``(mark, name)`` of all marked pieces of a text that can be a name: up to four words, no sign of a formula in it."""
    found = set()
    for opened, name, end in _SLOT.findall(text):
        mark = next((m for m in (opened, opened[1:], opened[2:]) if m in MARKS), None)
        if mark and MARKS[mark] == end and name[0].isalpha() and len(name) > 2:
            key = " ".join(w for w in _BETWEEN.split(_DIGITS.sub("#", name)) if w)
            if key.count(" ") < 4:
                found.add((mark.strip("=-"), key))
    return found


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One number per row from several."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _tokens(texts: list[str], ids: dict, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, id, inner, name)`` of all tokens: numbers, known names and sentence marks are one each, time marks left out.

    inner is false on the first and the last line of a text of several lines.
    ``names`` holds the known names of one, two and more words as numbers.
    """
    words = [_TOKEN.findall(t) for t in texts]
    size = np.array([len(w) + 2 for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    get = ids.__getitem__
    flat: list[int] = []
    for w in words:
        flat.append(_STOP)
        flat.extend(map(get, w))
        flat.append(_STOP)
    at = np.array(flat, np.int64)
    # lines of each text, the first being 0
    line = np.cumsum(at == _LINE)
    first = np.cumsum(size) - size
    line -= np.repeat(line[first] - (at[first] == _LINE), size)
    lines = np.repeat(np.bincount(doc, at == _LINE, len(texts)).astype(np.int64), size)
    inner = (lines == 0) | ((line > 0) & (line < lines))
    # a lone word before a colon opens what follows, it is no sentence of its own
    edge = (at == _STOP) | (at == _LINE)
    drop = (at == _SKIP) | (at == _LINE)
    drop[2:] |= edge[:-2] & (at[1:-1] > _NAME) & (at[2:] == _COLON)
    at[at == _COLON] = _STOP
    keep = ~drop
    doc, at, inner = doc[keep], at[keep], inner[keep]
    doc, at, inner, name = _lifted(doc, at, inner, names)
    keep = np.ones(len(at), bool)
    keep[1:] = (at[1:] != _STOP) | (at[:-1] != _STOP) | (doc[1:] != doc[:-1])
    return doc[keep], at[keep], inner[keep], name[keep]


def _lifted(doc: np.ndarray, at: np.ndarray, inner: np.ndarray, names: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Known names, the longest first, become one token each; the last array tells which name."""
    name = np.zeros(len(at), np.int64)
    for n in range(len(names), 0, -1):
        if not len(names[n - 1]) or len(at) < n:
            continue
        whole = at if n == 1 else _mix(*[at[i : len(at) - n + 1 + i] for i in range(n)])
        hit = np.flatnonzero(_among(whole, names[n - 1]) & (doc[: len(whole)] == doc[n - 1 :]))
        if len(hit):
            keep = np.ones(len(at), bool)
            for i in range(1, n):
                keep[hit + i] = False
            found, at, name = whole[hit], at.copy(), name.copy()
            keep[hit] = True
            at[hit], name[hit] = _NAME, found
            doc, at, inner, name = doc[keep], at[keep], inner[keep], name[keep]
    return doc, at, inner, name


def _windows(doc: np.ndarray, at: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(doc, window, inner, begins, ends)`` of every three tokens of one text that hold a word."""
    same = (doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, bool)
    n = len(same)
    h = _mix(at[:n], at[1 : n + 1], at[2 : n + 2])
    wordy = (at[:n] > _NAME) | (at[1 : n + 1] > _NAME) | (at[2 : n + 2] > _NAME)
    h = np.where(wordy, h, 0)
    i = inner[:n] & inner[1 : n + 1] & inner[2 : n + 2]
    return doc[:n][same], h[same], i[same], (at[:n] == _STOP)[same], (at[2 : n + 2] == _STOP)[same]


def _beside(doc: np.ndarray, at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(doc, words, name)``: what may border a slot, with the name that fills it (0: something else does).

    Every word and every two neighbours, once with what follows and once with what stands before; and the two
    tokens around every single one.
    """
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]

    def put(side: int, ends: tuple[np.ndarray, np.ndarray], where: np.ndarray, keep: np.ndarray, filler: np.ndarray, h: np.ndarray) -> None:
        a, b = ends
        keep = keep & ((a > _NAME) | (b > _NAME)) & (a != _NAME) & (b != _NAME)
        for column, x in zip(out, (where, (h & ~3) | side, filler), strict=True):
            column.append(x[keep])

    for n in (1, 2):
        m = max(len(doc) - n + 1, 0)
        a, b = at[:m], at[n - 1 :][:m]
        after, before = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if m > 1:
            after[:-1] = np.where(doc[n:] == doc[: m - 1], name[n:], 0)
            before[1:] = np.where(doc[: m - 1] == doc[1:m], name[: m - 1], 0)
        h, one = a if n == 1 else _mix(a, b), doc[:m] == doc[n - 1 :][:m]
        put(0, (a, b), doc[:m], one, after, h)
        put(1, (a, b), doc[:m], one, before, h)
    if len(doc) > 2:
        a, b = at[:-2], at[2:]
        put(2, (a, b), doc[:-2], doc[:-2] == doc[2:], name[1:-1], _mix(a, b))
    return tuple(map(np.concatenate, out))


_MOST = (1 << 63) - 1


def _slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of the batches of some MB each with their texts made readable."""
    for batch in batches:
        rows = max(1, int(len(batch) * limit / max(batch.nbytes, 1)))
        for start in range(0, len(batch), rows):
            part = batch.slice(start, rows)
            yield part, [_readable(t) for t in part.column(column).to_pylist()]


def variable_names(documents: DataFrame, text: str = "text", min_docs: int = 3) -> DataFrame:
    """``(name, habit)``: names that stand in marks of at least two kinds, in at least ``min_docs`` documents.

    Marks that hold more than four fifths of a name's cases are its habit: a way of writing (``[step 2]``), no
    template's. habit is null where no marks do.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0):
            seen: dict[tuple[str, str], int] = {}
            for t in texts:
                for slot in slot_names(t):
                    seen[slot] = seen.get(slot, 0) + 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([k[0] for k in seen], [k[1] for k in seen], list(seen.values()))], ["mark", "name", "n"])

    marked = documents.select(text).where(F.col(text).rlike(r"[{%<]|@@|\[\D|__"))
    counts = marked.mapInArrow(count, "mark string, name string, n long").groupBy("name", "mark").agg(F.sum("n").alias("n"))
    # a name has a row per kind of marks, of which there are few
    kinds = counts.groupBy("name").agg(F.sum("n").alias("all"), F.collect_list(F.struct("mark", "n")).alias("marks"))
    habit = F.get(F.filter("marks", lambda m: m["n"] > 0.8 * F.col("all")), 0)["mark"]
    return kinds.where((F.col("all") >= min_docs) & (F.size("marks") > 1)).select("name", habit.alias("habit"))


def _name_numbers(names: list[str]) -> list[np.ndarray]:
    """Known names of one to four words as numbers of tokens."""
    by_size: list[list[int]] = [[], [], [], []]
    for name in names:
        parts = [np.array([_NUMBER if w == "#" else _word_id(w)]) for w in name.split(" ")]
        by_size[len(parts) - 1].append(int(parts[0][0] if len(parts) == 1 else _mix(*parts)[0]))
    return [np.array(sorted(x), np.int64) for x in by_size]


def _numbers_of(known: DataFrame) -> list[np.ndarray]:
    """The numbers of all known names, however many: eight bytes a name are gathered, the names are not."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, numbers in enumerate(_name_numbers(batch.column(0).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), size, np.int32)), pa.array(numbers)], ["size", "number"])

    found = known.select("name").mapInArrow(number, "size int, number long").toArrow()
    sizes, numbers = (found.column(c).to_numpy() for c in ("size", "number"))
    return [np.unique(numbers[sizes == n]) for n in range(4)]


def template_windows(
    documents: DataFrame, names: list[np.ndarray], text: str = "text", min_docs: int = 3, min_share: float = 0.1, page_words: int = 40, surprise: float = 7.0, page_surprise: float = 3.0, inner_share: float = 0.1
) -> DataFrame:
    """``(what, h)`` of the windows (what 0), words (1) and words beside slots (2) that are templates' own.

    Of the documents that hold a window or word, at least ``min_docs`` and the share ``min_share`` are pages of
    at most ``page_words`` words, a tenth of these with it elsewhere than on their edge lines, and so many pages
    would come by chance with a probability below exp(-``surprise``) if it were spread like all others, and below
    exp(-``page_surprise``) if pages held it as often as other documents do. A word or two stand beside a slot that in four fifths of its documents, ``min_docs`` at least, border on known names, not
    always the same: what is there is a slot which nothing but variables fill.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for _, texts in _slices(batches, 0):
            doc, at, inner, name = _tokens(texts, ids, names)
            page = np.bincount(doc, at != _STOP, len(texts)) <= page_words
            wd, wh, wi, _, _ = _windows(doc, at, inner)
            word, held = at > _NAME, wh != 0
            pd_, ph, beside = _beside(doc, at, name)
            zero = [pa.array([x], pa.int64()) for x in (0, len(texts), int(page.sum()), 0, 0, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), *zero], _COUNTS)
            for what, d, h, hit in ((0, wd[held], wh[held], wi[held]), (1, doc[word], at[word], inner[word]), (2, pd_, ph, beside)):
                if not len(d):
                    continue
                # once per document, with a hit where it has one anywhere; the sort keeps the documents of one h in their order
                order = np.argsort(h, kind="stable")
                d, h, hit = d[order], h[order], hit[order].astype(np.int64)
                once = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
                d, h, hit = d[once], h[once], np.maximum.reduceat(hit, once)
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                on_page = page[d] if what < 2 else np.ones(len(d), bool)
                sums = [np.add.reduceat(x.astype(np.int64), start) for x in (np.ones(len(h)), on_page, on_page & (hit != 0))]
                ends = (np.minimum.reduceat(np.where(hit == 0, _MOST, hit), start), np.maximum.reduceat(hit, start))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), what, np.int32)), *map(pa.array, (h[start], *sums, *ends))], _COUNTS)
            if len(ids) > 500_000:
                ids.clear()

    counts = documents.select(text).mapInArrow(count, "what int, h long, n long, n_page long, n_hit long, low long, high long")
    counts = cut_lineage(counts.groupBy("what", "h").agg(*[F.sum(c).alias(c) for c in ("n", "n_page", "n_hit")], F.min("low").alias("low"), F.max("high").alias("high")))
    sizes = {r["what"]: r for r in counts.groupBy("what").agg(*[F.sum(c).alias(c) for c in ("n", "n_page")]).collect()}
    usual = [sizes[w]["n_page"] / sizes[w]["n"] if w in sizes else 1.0 for w in (0, 1)]
    texts = sizes[3] if 3 in sizes else None
    pages = texts["n_page"] / texts["n"] if texts else 1.0

    def surprise_over(share: Column) -> Column:
        expected = F.col("n") * F.greatest(share, F.lit(1e-9))
        return F.when(F.col("n_page") > expected, F.col("n_page") * F.log(F.col("n_page") / expected) - (F.col("n_page") - expected)).otherwise(0.0)

    often = (F.col("n_page") >= min_docs) & (F.col("n_page") >= max(min_share, 1.5 * pages) * F.col("n")) & (F.col("n_hit") >= inner_share * F.col("n_page"))
    rare = (surprise_over(F.when(F.col("what") == 0, usual[0]).otherwise(usual[1])) >= surprise) & (surprise_over(F.lit(pages)) >= page_surprise)
    slot = (F.col("n_hit") >= min_docs) & (F.col("n_hit") >= 0.8 * F.col("n")) & (F.col("low") < F.col("high"))
    out = counts.where(F.when(F.col("what") == 2, slot).otherwise((F.col("what") < 2) & often & rare))
    return out.select("what", "h")


_COUNTS = ["what", "h", "n", "n_page", "n_hit", "low", "high"]


def residue(
    documents: DataFrame, row_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_share: float = 0.1, page_words: int = 40, most_shared: int = 2_000_000
) -> DataFrame:
    """``(row_id, kinds)`` of the documents with residue; kinds among slot, default, template, filler.

    slot: a known variable's name stands in marks; default: a phrase that elsewhere stands around other
    variables' names; template: three windows in a row, or a whole sentence, of a template; filler: four words
    in a row that are pages' own. What a corpus holds only once or twice teaches nothing and is not found, so
    small corpora give few finds; a line of real content that is a page of its own in a tenth of its documents
    counts as a template.

    Null, empty and blank texts have none. Texts of any length are read whole, in any mix of languages; repeated
    rows give one finding; other columns are ignored; an empty table gives no rows. What is learnt is sent to the
    tasks while it is at most ``most_shared`` numbers; beyond that windows are joined to it instead.
    """
    texts = documents.where(F.col(text).isNotNull()).select(F.col(row_id).alias("_id"), F.col(text).alias("_t")).where(F.trim("_t") != "")
    spark = documents.sparkSession
    known = cut_lineage(variable_names(texts, "_t", min_docs))
    few_names = known.count() <= most_shared // 20
    habits = {r["name"]: r["habit"] for r in known.collect()} if few_names else None
    numbers = _numbers_of(known)
    flagged = cut_lineage(template_windows(texts, numbers, "_t", min_docs, min_share, page_words))
    few = flagged.count() <= most_shared
    shared = None
    if few:
        found = flagged.toPandas()
        shared = spark.sparkContext.broadcast([np.sort(found.loc[found["what"] == w, "h"].to_numpy(np.int64)) for w in range(3)])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()

        def rows(part: pa.RecordBatch, what: int, doc, h, pos, begins, ends, mark=None, name=None) -> pa.RecordBatch:
            at, none = pa.array(doc, pa.int64()), pa.nulls(len(doc), pa.string())
            columns = [part.column(0).take(at), part.column(1).take(at), pa.array(np.full(len(doc), what, np.int32)), *map(pa.array, (h, pos, begins, ends))]
            return pa.RecordBatch.from_arrays([*columns, none if mark is None else pa.array(mark), none if name is None else pa.array(name)], _PLACES)

        for part, plain in _slices(batches, 2):
            doc, at, inner, name = _tokens(plain, ids, numbers)
            wd, wh, _, begins, ends = _windows(doc, at, inner)
            word = at != _STOP
            near_doc, near, beside = _beside(doc, at, name)
            near_doc, near = near_doc[beside != 0], near[beside != 0]
            no = np.zeros(max(len(at), len(near)), bool)
            for what, d, h, b, e in ((0, wd, wh, begins, ends), (1, doc[word], at[word], no[: word.sum()], no[: word.sum()]), (2, near_doc, near, no[: len(near)], no[: len(near)])):
                keep = np.flatnonzero(_among(h, shared.value[what]) if shared is not None else h != 0)
                if len(keep):
                    yield rows(part, what, d[keep], h[keep], keep, b[keep], e[keep])
            marked = [(i, m, k) for i, t in enumerate(plain) for m, n in slot_names(t) for k in {n, n.rpartition(" ")[0]} if habits is None or habits.get(k, m) != m]
            if marked:
                i, m, n = (list(x) for x in zip(*marked, strict=True))
                order = np.arange(len(i))
                yield rows(part, 3, i, order, order, order < 0, order < 0, m, n)
            if len(ids) > 500_000:
                ids.clear()

    kind = documents.schema[row_id].dataType.simpleString()
    seen = texts.select("_id", F.xxhash64("_t").alias("_k"), "_t").mapInArrow(
        places, f"_id {kind}, _k long, what int, h long, pos long, begins boolean, ends boolean, mark string, name string"
    )
    if not few:
        seen = seen.where("what < 3").join(flagged, ["what", "h"], "left_semi").select(_PLACES).unionByName(seen.where("what = 3"))
    if not few_names:
        seen = seen.where("what < 3").unionByName(seen.where("what = 3").join(known, "name").where("habit is null or habit <> mark").select(_PLACES))
    # runs of neighbouring windows or words within a document, which bounds the window
    each = seen.select("_id", "_k", "what", "pos", "begins", "ends").distinct()
    run = F.col("pos") - F.row_number().over(Window.partitionBy("_id", "_k", "what").orderBy("pos"))
    runs = each.withColumn("run", run).groupBy("_id", "_k", "what", "run").agg(
        F.count("*").alias("n"), F.min_by("begins", "pos").alias("begins"), F.max_by("ends", "pos").alias("ends")
    )
    whole = F.col("begins") & F.col("ends") & (F.col("n") >= 2)
    verdict = (
        F.when(F.col("what") == 3, "slot").when(F.col("what") == 2, "default")
        .when((F.col("what") == 0) & ((F.col("n") >= 3) | whole), "template").when((F.col("what") == 1) & (F.col("n") >= 4), "filler")
    )
    found = runs.select(F.col("_id").alias(row_id), verdict.alias("kind")).where("kind is not null")
    return found.groupBy(row_id).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


_PLACES = ["_id", "_k", "what", "h", "pos", "begins", "ends", "mark", "name"]
