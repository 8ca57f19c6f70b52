"""Cutting documents into chunks, and finding the units that a chunk covers.

A splitter gives spans, places in a text, so that each chunk is known by where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RULE_HEADING, strip, words

Length = Callable[[str], int]
Span = tuple[int, int]


def windows(tokens: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` tokens, each ``size - overlap`` after the last; the final one ends with the tokens.

    The tokens are bound to a name first: within the loop their expression would be computed for every window."""
    if overlap >= size:
        raise ValueError(f"the overlap {overlap} must be smaller than the size {size}")
    step = size - overlap

    def cut(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / F.lit(float(step))), F.lit(0)).cast("int")
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return F.get(F.transform(F.array(tokens), cut), F.lit(0))


def chunk_fixed(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_no, text, n_tokens): windows of ``size`` words."""
    cut = docs.select("doc_id", F.posexplode(windows(words(F.col("text")), size, overlap)).alias("chunk_no", "w"))
    return cut.select("doc_id", "chunk_no", F.array_join("w", " ").alias("text"), F.size("w").alias("n_tokens"))


def chunk_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, text): cut before rule headings; what precedes the first one is kept."""
    parts = F.filter(F.transform(F.split("text", RULE_HEADING, -1), strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("chunk_no", "text"))


#: The separators in the order they are tried, and the headings of rules.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
HEADING = re.compile(r"^(?:RULE\s+\d+[:.]?|G\d{1,3}\b)", re.M)
WORDS = re.compile(r"\S+")


def count_words(text: str) -> int:
    return len(text.split())


def vocabulary_counter(path: str) -> Length:
    """Counts tokens by a vocabulary file of the tokenizers library; its path must be readable on the executors."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text: words, or those of a vocabulary file."""
    if path is None:
        return F.coalesce(F.size(words(text)), F.lit(0))

    @F.arrow_udf("int")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        length = vocabulary_counter(path)
        for some in batches:
            yield pa.array([length(t or "") for t in some.to_pylist()], pa.int32())

    return counted(text)


def fixed_spans(text: str, size: int, overlap: int, length: Length = count_words) -> list[Span]:
    """Windows of ``size`` words; the final one ends with the text."""
    found = [m.span() for m in WORDS.finditer(text)]
    out, at = [], 0
    while at < len(found):
        end = min(at + size, len(found))
        out.append((found[at][0], found[end - 1][1]))
        if end == len(found):
            break
        at += size - overlap
    return out


def split_spans(text: str, size: int, overlap: int, length: Length = count_words) -> list[Span]:
    """Spans of at most ``size`` by the first separator that occurs, oversize pieces by the next, small ones joined.

    The length of a span is counted as that of its pieces together, each counted once."""

    def pieces(a: int, b: int, seps: list[str]) -> list[tuple[int, int, int]]:
        n = length(text[a:b])
        if n <= size or not seps:
            return [(a, b, n)]
        sep = next((s for s in seps if s and s in text[a:b]), "")
        if not sep:  # by characters: halve until each half fits
            if b - a <= 1:
                return [(a, b, n)]
            mid = (a + b) // 2
            return pieces(a, mid, seps) + pieces(mid, b, seps)
        out, at = [], a
        rest = seps[seps.index(sep) + 1 :]
        while at < b:
            cut = text.find(sep, at + len(sep), b)
            end = b if cut < 0 else cut
            out += pieces(at, end, rest)
            at = end
        return out

    parts = pieces(0, len(text), SEPARATORS)
    spans: list[Span] = []
    first = last = total = 0  # parts[first:last] have this length together
    while last < len(parts):
        while last < len(parts) and (last == first or total + parts[last][2] <= size):
            total += parts[last][2]
            last += 1
        spans.append((parts[first][0], parts[last - 1][1]))
        begun = first
        while first < last and (total > overlap or first == begun):
            total -= parts[first][2]
            first += 1
        if last < len(parts):
            while first < last and total + parts[last][2] > size:
                total -= parts[first][2]
                first += 1
    return [(a, b) for a, b in spans if text[a:b].strip()]


def rule_spans(text: str, size: int, overlap: int, length: Length = count_words) -> list[Span]:
    """The sections between rule headings, what precedes the first one as well; those over ``size``, and texts without
    headings, are split further."""
    cuts = [m.start() for m in HEADING.finditer(text)]
    if not cuts:
        return split_spans(text, size, overlap, length)
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        section = text[a:b].strip()
        if section:
            a += len(text[a:b]) - len(text[a:b].lstrip())
            inner = [(0, len(section))] if length(section) <= size else split_spans(section, size, overlap, length)
            out += [(a + x, a + y) for x, y in inner]
    return out


STRATEGIES: dict[str, Callable[..., list[Span]]] = {
    "fixed": lambda text, size, overlap, length=count_words: fixed_spans(text, size, 0, length),
    "fixed_ov": fixed_spans,
    "recursive": split_spans,
    "rule_aware": rule_spans,
}


def register_strategy(name: str, splitter: Callable[..., list[Span]]) -> None:
    """A splitter is a function (text, size, overlap, length) to spans."""
    STRATEGIES[name] = splitter


def chunk_spans(docs: DataFrame, strategy: str, size: int = 500, overlap: int = 50, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, chunk_no, start, end, text, n_tokens): the stripped spans of a strategy; empty ones are left out, and
    their numbers with them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    if overlap >= size:
        raise ValueError(f"the overlap {overlap} must be smaller than the size {size}")
    splitter = STRATEGIES[strategy]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32())])

    @F.arrow_udf("array<struct<start: int, end: int, text: string, n_tokens: int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        length = vocabulary_counter(vocabulary) if vocabulary else count_words
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                row, t = [], t or ""
                for a, b in splitter(t, size, overlap, length):
                    body = t[a:b].strip()
                    a += len(t[a:b]) - len(t[a:b].lstrip())
                    row.append({"start": a, "end": a + len(body), "text": body, "n_tokens": length(body)})
                out.append(row)
            yield pa.array(out, pa.list_(span))

    cut = docs.select("doc_id", F.posexplode(spans("text")).alias("chunk_no", "s"))
    return cut.select("doc_id", "chunk_no", "s.start", "s.end", "s.text", "s.n_tokens").where("text <> ''")


def chunk_recursive(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_no, start, end, text) by split_spans."""
    return chunk_spans(docs, "recursive", size, overlap).drop("n_tokens")


def unit_offsets(units: DataFrame) -> DataFrame:
    """units with ``start`` and ``end`` in their document's text joined by one character."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return units.withColumn("start", start).withColumn("end", start + F.length("text"))


#: Characters of a cell by which chunks and units meet.
CELL = 2048


def in_cells(start: Column, end: Column) -> Column:
    """The cells of a text that a range touches; an empty one touches that of its place."""
    return F.sequence(F.floor(start / CELL), F.floor(F.greatest(end - 1, start) / CELL))


def chunk_locators(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, locators): the units whose range overlaps the chunk's, in order; the first unit if none does.

    Both sides are cut into cells, so that they meet by document and place: the pairs grow with the text, not with
    chunks times units."""
    c = chunks.select("doc_id", "chunk_no", F.col("start").alias("cs"), F.col("end").alias("ce"), F.explode(in_cells(F.col("start"), F.col("end"))).alias("cell"))
    u = offsets.select("doc_id", "locator", "pos", F.col("start").alias("us"), F.col("end").alias("ue"), F.explode(in_cells(F.col("start"), F.col("end"))).alias("cell"))
    met = c.join(u, ["doc_id", "cell"]).where((F.col("us") < F.col("ce")) & (F.col("cs") < F.col("ue")))
    grouped = met.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set(F.struct("pos", "locator"))).alias("l"))
    first = offsets.groupBy("doc_id").agg(F.min_by("locator", "pos").alias("first"))
    found = chunks.select("doc_id", "chunk_no").join(grouped, ["doc_id", "chunk_no"], "left").join(first, "doc_id", "left")
    return found.select("doc_id", "chunk_no", F.coalesce(F.transform("l", lambda x: x["locator"]), F.array("first")).alias("locators"))


def chunk_units(units: DataFrame, strategy: str = "recursive", size: int = 500, overlap: int = 50, presplit: tuple[str, ...] = ("xbrl",), vocabulary: str | None = None) -> DataFrame:
    """(chunk_id, doc_id, business_line, title, locators, text, meta) of units (kind, doc_id, business_line, title, pos,
    locator, text).

    Units of a ``presplit`` kind are chunks as they are.  Those of other documents are joined by blanks in their order
    and cut; a chunk names the units that it covers.  Line and title are those of a document's first unit."""
    whole = units.where(F.col("kind").isin(*presplit))
    meta = lambda **values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    doc_id = F.col("doc_id").cast("string")
    ready = whole.select(F.concat_ws("::", doc_id, "locator").alias("chunk_id"), "doc_id", "business_line", "title", F.array("locator").alias("locators"), "text", meta(strategy=F.lit("presplit")).alias("meta"))
    paged = units.where(~F.coalesce(F.col("kind").isin(*presplit), F.lit(False)))
    docs = paged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"), F.min_by("business_line", "pos").alias("business_line"), F.min_by("title", "pos").alias("title"))
    docs = docs.select("doc_id", "business_line", "title", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    chunks = chunk_spans(docs.select("doc_id", "text"), strategy, size, overlap, vocabulary)
    located = chunks.join(chunk_locators(chunks, unit_offsets(paged)), ["doc_id", "chunk_no"]).join(docs.select("doc_id", "business_line", "title"), "doc_id")
    cut = located.select(
        F.concat_ws("::", doc_id, F.lit(strategy), F.col("chunk_no").cast("string")).alias("chunk_id"), "doc_id", "business_line", "title", "locators", "text",
        meta(strategy=F.lit(strategy), size=F.lit(size), overlap=F.lit(overlap), n_tokens=F.col("n_tokens")).alias("meta"),
    )
    return ready.unionByName(cut)


def chunk(docs: DataFrame, strategy: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """chunk_spans with ``chunk_id``."""
    out = chunk_spans(docs, strategy, size, overlap)
    return out.withColumn("chunk_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.lit(strategy), F.col("chunk_no").cast("string")))
