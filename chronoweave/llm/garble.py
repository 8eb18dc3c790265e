"""Text that was read with a wrong character encoding: finding it, learning how it came about, restoring it.

1. Every document is cut into lines with non-ASCII characters; a line keeps the hash of its text without them (its
   skeleton) and its cells, the words that contain such characters.
2. Lines of equal skeleton, and words of equal skeleton, are near-twins: within each such group the most frequent variant
   is paired with the others. The cells of a pair are aligned character by character: each clean character with the
   garbled piece in its place. From the pieces the transformations are inferred: pairs of encodings (bytes written in one,
   read in the other) that turn every clean character of the cell into its piece. Pairs that several cells support are
   learned. Pieces that no pair of encodings explains vote for a table of their own, from piece to character, which holds
   what several cells of strange form agree on; so a transformation outside the list of encodings is learned as well.
3. The learned transformations are applied backwards to all cells of the corpus. A cell counts as garbled if what comes
   out is a known, more frequent word, is a known word of a more usual form (one alphabet, usual case), or is written in
   well-formed multi-byte sequences; characters that only damage leaves behind (U+FFFD, C1 controls) speak for themselves.
   Single-byte misreadings count words also by distinct places (the cells before and after them), where variants of one
   text that share a passage count as one.
4. A document is found if it has a cell of strong evidence or several of weak evidence for one transformation.

Reading bytes of UTF-8 in a single-byte encoding leaves well-formed multi-byte sequences, so those transformations are
tried even where no twin taught them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.scale import keep, sized_broadcast

# Encodings in which text is written and in which bytes are wrongly read.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "iso8859-5", "koi8-r", "mac_roman", "mac_cyrillic")
READ = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "iso8859-5", "iso8859-15", "koi8-r", "mac_roman", "mac_cyrillic")

#: Distinct cells that must support a transformation before it is applied to other records.
SUPPORT = 2

#: For words without ASCII letters, of so many characters at least: distinct cells together must have so many changed ones.
BARE_CHANGES, BARE_LENGTH = 10, 4

#: Transformations may have been applied this many times on top of each other.
DEPTH = 3

#: Name of the learned table of pieces among the transformations; pieces of so many characters at most; a piece belongs to a
#: character if so much of its support agrees.
TABLE, LONGEST, AGREED = "aligned", 4, 0.9

#: A line's skeleton must have this many characters to identify twins; a word's so many letters.
LINE_SKELETON, WORD_SKELETON = 24, 3

CELL = r"(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7F]++[A-Za-z]*+)+"
_DAMAGE = "[�\x80-\x9f]"


@cache
def reading(name: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes without a character are read as C1 controls."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@cache
def _letters(name: str) -> dict[int, str]:
    return {b: c for c, b in reading(name).items()}


@cache
def _turn(read: str, written: str) -> dict[int, str]:
    """Code point -> what its byte stood for, of the characters beyond ASCII."""
    back = _letters(written)
    return {ord(c): back[b] for c, b in reading(read).items() if c >= "\x80" and b in back}


def undo(cell: str, read: str, written: str) -> tuple[str, int, int] | None:
    """What `cell` was before bytes of `written` were read as `read`: the text, how many characters were put right, and how
    many non-ASCII ones were left as they are; None if nothing changes.

    Single-byte texts must be put right as a whole; of UTF-8 every well-formed sequence is, wherever it lies.
    """
    if written != "utf-8":
        turn = _turn(read, written)
        if any(c >= "\x80" and ord(c) not in turn for c in cell):
            return None
        out = cell.translate(turn)
        return (out, sum(a != b for a, b in zip(out, cell, strict=True)), 0) if out != cell else None
    table = reading(read)
    done = left = 0
    parts: list[str] = []
    i, n = 0, len(cell)
    while i < n:
        c = cell[i]
        b = table.get(c, -1) if c >= "\x80" else -1
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if size and i + size <= n:
            rest = [table.get(x, 0) if x >= "\x80" else 0 for x in cell[i + 1 : i + size]]
            if all(0x80 <= r < 0xC0 for r in rest):
                try:
                    parts.append(bytes([b, *rest]).decode("utf-8"))
                    done += 1
                    i += size
                    continue
                except UnicodeDecodeError:
                    pass
        left += c >= "\x80"
        parts.append(c)
        i += 1
    return ("".join(parts), done, left) if done else None


_RUNS = re.compile(r"[^\x00-\x7F]+")


def align(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """The clean characters beyond ASCII with the garbled piece in each one's place; None where the texts do not fit.

    The ASCII characters of both must be the same. Between them, runs of as many characters are aligned one to one, others
    by the characters' lengths in UTF-8, else in pieces of equal length.
    """
    if _RUNS.split(garbled) != _RUNS.split(clean):
        return None
    out: list[tuple[str, str]] = []
    for g, c in zip(_RUNS.findall(garbled), _RUNS.findall(clean), strict=True):
        sizes = [len(x.encode("utf-8", "surrogatepass")) for x in c]
        if len(g) == len(c):
            sizes = [1] * len(c)
        elif sum(sizes) != len(g):
            if len(g) % len(c):
                return None
            sizes = [len(g) // len(c)] * len(c)
        at = 0
        for x, n in zip(c, sizes, strict=True):
            out.append((g[at : at + n], x))
            at += n
    return out


@lru_cache(100_000)
def explain(piece: str, clean: str) -> frozenset[tuple[str, str]]:
    """The transformations, as (read, written), that turn the clean character into the piece, once or on top of each other."""
    out = []
    for r in READ:
        if any(c >= "\x80" and c not in reading(r) for c in piece):
            continue
        for w in WRITTEN:
            text = piece
            for _ in range(DEPTH if w == "utf-8" else 1):
                step = undo(text, r, w)
                if step is None:
                    break
                text = step[0]
                if text == clean:
                    out.append((r, w))
                    break
            # a character that both encodings share is left as it is
            if piece == clean and w != "utf-8" and _turn(r, w).get(ord(clean)) == clean:
                out.append((r, w))
    return frozenset(out)


def infer(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The transformations that turn every aligned character of `clean` into its piece of `garbled`."""
    pieces = align(garbled, clean)
    if not pieces or garbled == clean:
        return []
    common = explain(*pieces[0])
    for p in pieces[1:]:
        common = common & explain(*p)
    return sorted(common)


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return name.split(" ")[0] if c.isalpha() else ""


def odd(cell: str) -> bool:
    """Letters of two alphabets in one word, or a sign that touches letters and is no quote, dash, mark or other punctuation."""
    scripts = {_script(c) for c in cell if c.isalpha()}
    if len(scripts & {"LATIN", "CYRILLIC", "GREEK"}) > 1:
        return True
    inside = any(c.isalpha() for c in cell)
    return inside and any(c >= "\x80" and unicodedata.category(c) in ("Sm", "So", "Sc", "Sk", "No", "Po") and c not in "¿¡…" for c in cell)


def strange(cell: str) -> int:
    """How unusual the form of a word is, whatever its frequency: 2 for odd words, changing case inside a run of letters, and
    Latin words of three letters and more that are all accented; 1 for capitals only; else 0."""
    runs = re.findall(r"[^\W\d_]+", cell)
    if odd(cell) or any(not (x.islower() or x.isupper() or x[1:].islower() or x.lower() == x.upper()) for x in runs):
        return 2
    letters = "".join(runs)
    if len(letters) > 2 and all(c >= "\x80" and _script(c) == "LATIN" for c in letters):
        return 2
    return int(len(letters) > 1 and letters.isupper())


def candidates(cell: str, learned: list[tuple[str, str]], pieces: dict[str, str] | None = None) -> list[tuple[str, str, str, int, int]]:
    """What the cell may have been: (text, read, written, characters put right, non-ASCII characters left). `pieces` is the
    table of what no encodings explain."""
    out: dict[tuple[str, str, str], tuple[str, str, str, int, int]] = {}
    own = {c for c in cell if c >= "\x80"}
    whole = {r: own <= reading(r).keys() for r in {r for r, _ in learned}}
    for r, w in learned:
        if w != "utf-8" and not whole[r]:
            continue
        text, done = cell, 0
        for _ in range(DEPTH if w == "utf-8" else 1):
            step = undo(text, r, w)
            if step is None:
                break
            text, n, left = step
            done = max(done, n)
            out[text, r, w] = (text, r, w, done, left)
    if pieces:
        hits = 0

        def turn(m: re.Match) -> str:
            nonlocal hits
            run, at, parts = m.group(), 0, []
            while at < len(run):
                n = next((n for n in range(LONGEST, 0, -1) if run[at : at + n] in pieces), 0)
                hits += n > 0
                parts.append(pieces[run[at : at + n]] if n else run[at])
                at += n or 1
            return "".join(parts)

        text = _RUNS.sub(turn, cell)
        if hits:
            kept = sum(c >= "\x80" for c in cell) - hits
            out[text, TABLE, TABLE] = (text, TABLE, TABLE, hits, max(kept, 0))
    return list(out.values())


def cells_of(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, copy (hash of the text: exact copies count once), damaged (whether the text holds U+FFFD or C1 controls), lines
    (array of skeleton hash and cells)."""
    line = F.split(F.col(text), r"\r\n?|\n")
    touched = F.filter(line, lambda x: x.rlike(r"[^\x00-\x7F]"))

    def one(x: Column) -> Column:
        skeleton = F.regexp_replace(x, r"[^\x00-\x7F]+", "")
        key = F.when(F.length(skeleton) >= LINE_SKELETON, F.xxhash64(skeleton, F.lit(1)))
        return F.struct(key.alias("h"), F.regexp_extract_all(x, F.lit(CELL), F.lit(0)).alias("cells"))

    return df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).rlike(_DAMAGE).alias("damaged"), F.transform(touched, one).alias("lines"))


def twins(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs garbled -> clean of cells: variants of lines with one skeleton, and of words with one skeleton, each against the
    most frequent variant of its group. The more frequent one may still be the garbled one."""
    x = lines.select("copy", F.explode("lines").alias("l")).select("copy", "l.*").where("h is not null")
    variants = x.groupBy("h", "cells").agg(F.count_distinct("copy").alias("n"))
    w = Window.partitionBy("h")
    best = F.max(F.struct("n", "cells")).over(w)
    pairs = variants.withColumn("best", best["cells"]).where(F.col("cells") != F.col("best")).where(F.size("cells") == F.size("best"))
    a = pairs.select(F.explode(F.arrays_zip(F.col("cells").alias("g"), F.col("best").alias("c"))).alias("z")).select("z.g", "z.c").where("g != c")
    s = words.withColumn("s", F.regexp_replace("cell", "[^A-Za-z]", "")).where(F.length("s") >= WORD_SKELETON)
    # by copies and by places
    top = s.groupBy("s").agg(F.array_distinct(F.array(*(F.max(F.struct(*k, "cell"))["cell"] for k in (("copies",), ("n", "copies"))))).alias("c"), F.max("copies").alias("copies_"), F.max("n").alias("n_"))
    b = s.join(top, "s").where((F.col("copies") < F.col("copies_")) | (F.col("n") < F.col("n_"))).select(F.col("cell").alias("g"), F.explode("c").alias("c")).where("g != c")
    return a.unionByName(b).distinct()


def _infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        turned = [(c, g) if strange(c) > strange(g) else (g, c) for g, c in x[["g", "c"]].itertuples(index=False)]
        out = []
        for g, c in turned:
            seen = infer(g, c)
            out += [(r, w, g) for r, w in seen]
            if not seen and strange(g) > 1 and not strange(c):
                out += [(p, t, g) for p, t in set(align(g, c) or ()) if p != t and len(p) <= LONGEST]
        if out:
            yield pd.DataFrame(out, columns=["read", "written", "g"])


def learn(lines: DataFrame, words: DataFrame, bare_words: bool = True) -> tuple[list[tuple[str, str, int]], dict[str, str]]:
    """(read, written, support) of the transformations seen in twins, and the table of pieces that no encodings explain. At
    most one row per pair of encodings, and per piece and character, reaches the driver.

    Words without any ASCII letter all have the same skeleton, so for scripts other than Latin they are twins if one
    transformation turns one into the other, a more frequent one or one of more usual form (`bare_words`).
    """
    votes = twins(lines, words).mapInPandas(_infer, "read string, written string, g string")
    seen = votes.groupBy("read", "written").agg(F.count_distinct("g").alias("n")).where(F.col("n") >= SUPPORT)
    if bare_words:
        bare = words.where((F.length("cell") >= BARE_LENGTH) & F.col("cell").rlike(r"^[^\x00-\x7F]+$"))
        pairs = [(r, w) for w in WRITTEN if w != "utf-8" for r in READ if r != w]
        same = bare.mapInPandas(_propose(pairs), _PROPOSED).join(_known(bare), "clean").where(_better() | _usual())
        rare = same.groupBy("read", "written").agg(F.count(F.lit(1)).alias("n"), F.sum("done").alias("changes")).where(F.col("changes") >= BARE_CHANGES).drop("changes")
        seen = seen.unionByName(rare).groupBy("read", "written").agg(F.max("n").alias("n"))
    rows = [(r["read"], r["written"], r["n"]) for r in seen.collect()]
    pairs_ = sorted((x for x in rows if x[0] in READ), key=lambda x: (-x[2], x))
    support: dict[str, dict[str, int]] = {}
    for piece, clean, n in rows:
        if piece not in READ:
            support.setdefault(piece, {})[clean] = n
    table = {p: max(v, key=lambda c, v=v: (v[c], c)) for p, v in support.items() if max(v.values()) >= AGREED * sum(v.values())}
    return pairs_, table


_PROPOSED = "cell string, n long, copies long, odd boolean, stranger int, clean string, read string, written string, done int, left int"


def vocabulary(lines: DataFrame) -> DataFrame:
    """cell, copies (distinct texts that have it), n (distinct places, the cells before and after it; at most `copies`)."""
    seq = F.flatten("lines.cells")
    near = F.arrays_zip(seq.alias("cell"), F.concat(F.array(F.lit("")), seq).alias("before"), F.slice(seq, 2, F.greatest(F.size(seq), F.lit(1))).alias("after"))
    at = lines.select("copy", F.explode(near).alias("z")).where("z.cell is not null").select("copy", "z.cell", F.xxhash64("z.before", "z.after").alias("place"))
    x = at.groupBy("cell").agg(F.count_distinct("copy").alias("copies"), F.count_distinct("place").alias("n"))
    return x.select("cell", "copies", F.least("n", "copies").alias("n"))


def _known(words: DataFrame) -> DataFrame:
    return words.select(F.col("cell").alias("clean"), F.col("n").alias("known"), F.col("copies").alias("known_copies"))


def _better() -> Column:
    """Whether the clean form is the more frequent one."""
    known, copies = F.coalesce(F.col("known"), F.lit(0)), F.coalesce(F.col("known_copies"), F.lit(0))
    more = copies > F.col("copies")
    places = (known > F.col("n")) | ((known == F.col("n")) & more)
    # many texts that share few places may be variants of one; they don't make the stranger form of a word the clean one
    return F.when(F.col("written") == "utf-8", more).otherwise(places | (more & (F.col("stranger") >= 0)))


def _usual() -> Column:
    """Whether the clean form of a single-byte text is known and the more usual one, however often the garbled one occurs."""
    return (F.col("written") != "utf-8") & (F.col("stranger") > 0) & (F.coalesce(F.col("known_copies"), F.lit(0)) > 1)


def _propose(learned: list[tuple[str, str]], pieces: dict[str, str] | None = None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for cell, n, copies in x[["cell", "n", "copies"]].itertuples(index=False):
                o, s = odd(cell), strange(cell)
                out += [(cell, n, copies, o, s - strange(t), t, r, w, done, left) for t, r, w, done, left in candidates(cell, learned, pieces)]
            if out:
                yield pd.DataFrame(out, columns=["cell", "n", "copies", "odd", "stranger", "clean", "read", "written", "done", "left"])

    return run


def judge(words: DataFrame, learned: list[tuple[str, str]], pieces: dict[str, str] | None = None) -> DataFrame:
    """cell, clean, read, written, strong: the garbled cells of the vocabulary, one row per cell and transformation."""
    # a clean form may have lost all its non-ASCII characters; such words are not in the vocabulary and count as unknown
    c = words.mapInPandas(_propose(learned, pieces), _PROPOSED).join(_known(words), "clean", "left")
    many = F.col("written") == "utf-8"
    better = F.coalesce(_better(), F.lit(False))
    cyrillic = F.col("read").isin("cp1251", "cp866", "iso8859-5", "koi8-r", "mac_cyrillic")
    latin = F.col("cell").rlike("[A-Za-z]")
    whole = many & (F.col("left") == 0)
    strong = (many & better & (~cyrillic | latin | (F.col("done") > 1))) | (whole & (F.col("done") > 1)) | (~many & better & F.col("odd") & (F.col("known_copies") > 1))
    weak = whole | better | _usual()
    return c.withColumn("strong", strong).where(strong | weak).select("cell", "clean", "read", "written", "strong", F.coalesce("known_copies", F.lit(0)).alias("known"), "left")


def garbled(df: DataFrame, doc_id: str = "doc_id", text: str = "text", twins_only: bool = False) -> DataFrame:
    """Documents with garbled passages: doc_id, fixes (map from garbled to restored cell; empty where nothing can be put
    right). See the module for the evidence.

    `twins_only` leaves out what is added to the method: words without ASCII letters as twins of each other, misread UTF-8
    that no twin taught, and characters that only damage leaves behind.

    Null, empty and pure ASCII texts are never found. Rows that repeat a doc_id are one document. Texts are read whole; an
    empty table gives an empty result. Other columns of `df` take no part, whatever their names.
    """
    lines = keep(cells_of(df, doc_id, text))
    own = lines.select("doc_id", F.explode(F.array_distinct(F.flatten("lines.cells"))).alias("cell"))
    words = keep(vocabulary(lines))
    seen, pieces = learn(lines, words, bare_words=not twins_only)
    learned = [(r, w) for r, w, _ in seen]
    always = [] if twins_only else [(r, "utf-8") for r in READ if (r, "utf-8") not in learned]
    verdict = judge(words, learned + always, pieces)
    hit = own.join(sized_broadcast(verdict), "cell")
    per = hit.groupBy("doc_id", "read", "written").agg(F.max("strong").alias("strong"), F.count_distinct("cell").alias("cells"), F.collect_list(F.struct((-F.col("known")).alias("k"), F.col("left").alias("l"), "cell", "clean")).alias("all"))
    found = per.where(F.col("strong") | (F.col("cells") > 1)).groupBy("doc_id").agg(F.flatten(F.collect_list("all")).alias("all"))
    # of several readings of one cell the best known wins: sorted last, so that it stays in the map
    order = F.reverse(F.array_sort(F.array_distinct("all")))
    latest = F.aggregate(order, F.expr("cast(map() as map<string, string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["cell"]), F.create_map(x["cell"], x["clean"])))
    fixes = found.select("doc_id", latest.alias("fixes"))
    if twins_only:
        return fixes
    damaged = lines.where("damaged").select("doc_id").distinct()
    return fixes.join(damaged, "doc_id", "full_outer").select("doc_id", F.coalesce("fixes", F.expr("cast(map() as map<string, string>)")).alias("fixes"))


def restore(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: the texts of the found documents with the fixes applied; damage that lost bytes stays as it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = re.compile(CELL)
        for x in frames:
            texts = []
            for t, f in zip(x["text"], x["fixes"], strict=True):
                m = dict(f)
                texts.append(cell.sub(lambda g, m=m: m.get(g.group(), g.group()), t) if m else t)
            yield pd.DataFrame({"doc_id": x["doc_id"], "text": texts})

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(found, "doc_id").mapInPandas(run, "doc_id long, text string")
