"""Letter and width statistics, font names and the choice of a substitute font.

``widths`` is (font_key, letter, width) in thousandths of an em; spans name their font in ``font``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.batches import changes, together
from ..params import DEFAULTS, Params


def letters_of(df: DataFrame, col: str = "text") -> DataFrame:
    """A row per letter, with its place ``at``."""
    return df.select("*", F.posexplode(F.split(col, "")).alias("at", "letter")).where("letter <> ''")


def letter_counts(df: DataFrame, key: list[str], col: str = "text") -> DataFrame:
    """How often each letter stands in a text: what sums over letters need, in far fewer rows."""
    return df.select(*key, F.explode(F.split(col, "")).alias("letter")).where("letter <> ''").groupBy(*key, "letter").agg(F.count("*").alias("n"))


#: Widths up to this number of rows, and of cells as a table of fonts by letters, are sent to all tasks; more are joined.
MOST_WIDTHS, MOST_CELLS = 100_000, 4_000_000


class WidthTable:
    """Widths of single letters by font, as a table; what has none is not a number. A null width is one that is not there, but the letter is (``has``)."""

    def __init__(self, rows: list[tuple[str, str, float | None]]):
        letters = sorted({ord(c) for _, c, _ in rows})
        self.fonts = {f: i for i, f in enumerate(dict.fromkeys(r[0] for r in rows))}
        self.place = np.full((letters[-1] if letters else 0) + 2, len(letters), np.int32)
        self.place[letters] = np.arange(len(letters))
        self.width = np.full((len(self.fonts) + 1, len(letters) + 1), np.nan)
        self.has = np.zeros(self.width.shape, bool)
        for f, c, w in rows:
            self.width[self.fonts[f], self.place[ord(c)]] = np.nan if w is None else w
            self.has[self.fonts[f], self.place[ord(c)]] = True

    def places(self, letters: np.ndarray) -> np.ndarray:
        """Each code point's column; one without any width has the last, which is empty."""
        return self.place[np.minimum(letters, len(self.place) - 1)]

    def of(self, fonts: pa.Array) -> np.ndarray:
        """Each font's row; an unknown one has the last, which is empty."""
        coded = fonts.dictionary_encode()
        rows = np.array([self.fonts.get(f, len(self.fonts)) for f in coded.dictionary.to_pylist()] + [len(self.fonts)])
        return rows[coded.indices.fill_null(len(rows) - 1).to_numpy(zero_copy_only=False)]


def width_table(widths: DataFrame) -> WidthTable | None:
    """The widths as a table, if they are few; null if they are many, or some are told twice."""
    rows = [tuple(r) for r in widths.where("font_key is not null and char_length(letter) = 1").select("font_key", "letter", F.col("width").cast("double")).limit(MOST_WIDTHS + 1).collect()]
    cells = (len({r[0] for r in rows}) + 1) * (len({r[1] for r in rows}) + 1)
    return WidthTable(rows) if len(rows) <= MOST_WIDTHS and cells <= MOST_CELLS and len({r[:2] for r in rows}) == len(rows) else None


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, n): code points of all texts, and how many each text has."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if not len(data) or data.max() < 128:
        return data.astype(np.int32), np.diff(ends)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    letters = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.int32)
    if len(letters) == before[-1]:
        return letters, np.diff(before[ends - ends[0]])
    # bytes that are no text: told one by one
    listed = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
    return np.frombuffer("".join(listed).encode("utf-32-le"), np.int32), np.array([len(x) for x in listed], np.int64)


def letter_sums(texts: pa.Array, fonts: pa.Array, table: WidthTable, space: float | None) -> list[np.ndarray]:
    """Per text: the sum of its letters' widths, how many letters have none, letters, and spaces. ``space``: a space's width where it has none; null: spaces are counted only, and are 0 wide."""
    letters, n = _letters(texts)
    wide = table.width.copy()
    blank = int(table.places(np.array([32]))[0])
    if blank == wide.shape[1] - 1:  # no font has a space: it has a column of its own
        wide = np.concatenate([wide, np.full((len(wide), 1), np.nan)], axis=1)
        blank += 1
    wide[:, blank] = 0.0 if space is None else np.where(np.isnan(wide[:, blank]), space, wide[:, blank])
    is_space = letters == 32
    at = table.places(letters)
    at[is_space] = blank
    at += np.repeat((table.of(fonts) * wide.shape[1]).astype(np.int32), n)
    lost = np.isnan(wide).ravel()
    some = n > 0
    begins = (np.cumsum(n) - n)[some]

    def total(x: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(len(n), kind)
        if len(begins):
            out[some] = np.add.reduceat(x, begins, dtype=kind)
        return out

    return [total(np.where(lost, 0.0, wide.ravel())[at], float), total(lost[at], np.int64), n, total(is_space, np.int64)]


def _told(df: DataFrame, told: Callable[[pa.RecordBatch], tuple[np.ndarray, list[pa.Array]]], keep: list[str], out: str) -> DataFrame:
    """The rows of ``df`` that ``told`` (places, and cells for each of those) names, as columns ``keep`` and ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, cells = told(batch)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], *cells], names=[*keep, *[x.split()[0] for x in out.split(", ")]])

    return df.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema], out]))


def with_letter_sums(df: DataFrame, table: WidthTable, space: float | None, col: str = "text", font: str = "font") -> DataFrame:
    """``df`` with ``letter_sums`` as ``_sum``, ``_unknown``, ``_letters`` and ``_spaces``: letter by letter, and no row a letter."""
    told = lambda batch: (np.arange(batch.num_rows), [pa.array(x) for x in letter_sums(batch.column(col), batch.column(font), table, space)])
    return _told(df, told, df.columns, "_sum double, _unknown bigint, _letters bigint, _spaces bigint")


def line_width(texts: DataFrame, widths: DataFrame, key: list[str], p: Params = DEFAULTS, col: str = "text") -> DataFrame:
    """Per text (key, font, size, spacing) its width in points and how many letters have no width. A space without a width is a quarter em. ``key`` tells one text.

    Where widths are few, each text is told by itself where it is; else letters meet widths in a join.
    """
    table = width_table(widths)
    if table:
        return with_line_width(texts.select(*dict.fromkeys([*key, "font", "size", "spacing", col])), table, "width", "unknown", p, col).select(*key, "width", "unknown")
    n = letter_counts(texts, [*key, "font", "size", "spacing"], col)
    w = n.join(widths.select(F.col("font_key").alias("font"), "letter", "width"), ["font", "letter"], "left")
    wide = F.coalesce("width", F.when(F.col("letter") == " ", p.space_em * 1000))
    return w.groupBy(*key).agg(F.round(F.sum(F.col("n") * F.coalesce(wide, F.lit(0.0)) * F.col("size") / 1000 + F.col("spacing") * F.col("n") * F.col("size")), 4).alias("width"), F.sum(F.when(wide.isNull(), F.col("n")).otherwise(0)).alias("unknown"))


def line_widths(texts: DataFrame, widths: DataFrame, key: list[str], cols: dict[str, str], p: Params = DEFAULTS) -> DataFrame:
    """``key`` and the widths in points of several texts of a row (column -> width's column): ``line_width`` of each, of rows whose texts all have letters."""
    table = width_table(widths)
    if table:
        out = texts
        for col, width in cols.items():
            out = with_line_width(out, table, width, p=p, col=col)
        return out.select(*key, *cols.values())
    told = [line_width(texts, widths, key, p, col).select(*key, F.col("width").alias(width)) for col, width in cols.items()]
    return reduce(lambda a, b: a.join(b, key), told)


def with_line_width(texts: DataFrame, table: WidthTable, width: str, unknown: str | None = None, p: Params = DEFAULTS, col: str = "text") -> DataFrame:
    """``texts`` with letters (font, size, spacing) and their ``width`` in points, and how many letters have none (``unknown``)."""
    n = with_letter_sums(texts, table, p.space_em * 1000, col).where("_letters > 0")
    n = n.withColumn(width, F.round(F.col("_sum") * F.col("size") / 1000 + F.col("spacing") * F.col("_letters") * F.col("size"), 4))
    return (n.withColumn(unknown, F.col("_unknown")) if unknown else n).drop("_sum", "_unknown", "_letters", "_spaces")


GAP = "doc_id long, page int, font string, gap double"


def usual_gaps(batches: Iterator[pa.RecordBatch], table: WidthTable) -> Iterator[pa.RecordBatch]:
    """``GAP`` of pieces (doc_id, page, font, size, text, wide), those of one page following each other: per page and font the median over spaces, null without any."""
    for batch in together(batches, ["doc_id", "page"]):
        run, fonts = np.cumsum(changes(batch, ["doc_id", "page"])) - 1, batch.column("font").dictionary_encode()
        font = fonts.indices.fill_null(len(fonts.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        total, _, _, spaces = letter_sums(batch.column("text"), batch.column("font"), table, None)
        size, wide = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "wide"))
        group, head, of = np.unique(run << 20 | font, return_index=True, return_inverse=True)
        piece = np.repeat(np.arange(batch.num_rows), spaces)
        gap = ((wide[piece] - total[piece] * size[piece] / 1000) / spaces[piece] / size[piece]) * 1e4
        gap = np.sign(gap) * np.floor(np.abs(gap) + 0.5 + 1e-7) / 1e4
        order = np.lexsort((gap, of[piece]))
        n = np.bincount(of[piece], minlength=len(group))
        begin, some = np.cumsum(n) - n, n > 0
        mid = np.full(len(group), np.nan)
        low, high = (gap[order[(begin + (n - k) // 2)[some]]] for k in (1, 0))
        mid[some] = (low + high) / 2
        at = pa.array(head)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("doc_id", "page", "font")], pa.array(mid, mask=~some)], names=["doc_id", "page", "font", "gap"])


def usual_gap(pieces: DataFrame, widths: DataFrame, space: DataFrame) -> DataFrame:
    """Per (doc_id, page, font): the median over spaces of (piece width - its letters' width) / spaces / size, each space counting; a font without spaces falls back to its own space width (font, space).

    Where widths are few, a page's pieces meet in one place and are told there; else letters meet widths in a join.
    """
    wide = (F.col("bbox.x1") - F.col("bbox.x0")).alias("wide")
    table = width_table(widths)
    if table:
        each = pieces.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "font", F.col("size").cast("double").alias("size"), F.coalesce("text", F.lit("")).alias("text"), wide.cast("double"))
        dealt = each.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")
        return with_space(dealt.mapInArrow(lambda batches: usual_gaps(batches, table), GAP), space)
    key = ["doc_id", "page", "line_no", "piece_no", "font", "size"]
    n = letter_counts(pieces.select(*key, "text", wide), [*key, "wide"])
    w = n.join(widths.select(F.col("font_key").alias("font"), "letter", "width"), ["font", "letter"], "left")
    per = w.groupBy(*key, "wide").agg(F.sum(F.when(F.col("letter") == " ", F.col("n")).otherwise(0)).alias("spaces"), F.sum(F.when(F.col("letter") != " ", F.col("n") * F.coalesce("width", F.lit(0.0)))).alias("letters"))
    gap = F.round((F.col("wide") - F.coalesce("letters", F.lit(0.0)) * F.col("size") / 1000) / F.col("spaces") / F.col("size"), 4)
    each = per.where("spaces > 0").select("doc_id", "page", "font", gap.alias("gap"), "spaces")
    mid = each.select("doc_id", "page", "font", "gap", F.explode(F.sequence(F.lit(1).cast("long"), "spaces"))).groupBy("doc_id", "page", "font").agg(F.median("gap").alias("gap"))
    return with_space(pieces.select("doc_id", "page", "font").distinct().join(mid, ["doc_id", "page", "font"], "left"), space)


def with_space(gaps: DataFrame, space: DataFrame) -> DataFrame:
    """``gaps`` with a font's own space width (font, space) where a page has none."""
    return gaps.join(space, "font", "left").select("doc_id", "page", "font", F.round(F.coalesce("gap", "space"), 4).alias("gap"))


def letter_spacing(glyphs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per span of glyphs (doc_id, span, drawn_no, letter, x, y, listed, drawn, size): the median of (next x - x - width) / size over neighbours, by listed widths; kept only if at least 0.015 em and the median by drawn widths agrees. Pairs at a space, on other baselines or going back do not count."""
    w = Window.partitionBy("doc_id", "span").orderBy("drawn_no")
    nxt = lambda c: F.lead(c).over(w)
    g = glyphs.withColumn("_x", nxt("x")).withColumn("_y", nxt("y")).withColumn("_l", nxt("letter"))
    pairs = g.where((F.col("_y") == F.col("y")) & (F.col("_x") > F.col("x")) & (F.trim("letter") != "") & (F.trim("_l") != ""))
    gap = lambda c: F.median(F.round((F.col("_x") - F.col("x") - F.col(c)) / F.col("size"), 6))
    m = pairs.groupBy("doc_id", "span").agg(gap("listed").alias("a"), gap("drawn").alias("b"))
    ok = (F.abs("a") >= p.letter_spacing_least) & (F.abs(F.col("a") - F.col("b")) <= p.letter_spacing_apart)
    return m.select("doc_id", "span", F.round(F.when(ok, F.col("a")).otherwise(0.0), 6).alias("spacing"))


def missing_letters(texts: DataFrame, coverage: DataFrame, key: list[str], col: str = "text") -> DataFrame:
    """Texts (key, font) with ``missing``: distinct letters their font cannot draw, in first-seen order. A plain space always draws; texts that lack nothing have no row. ``key`` tells one text.

    Where the coverage is small, each text is told by itself where it is; else letters meet it in a join.
    """
    table = width_table(coverage.select("font_key", "letter", F.lit(None).cast("double").alias("width")).distinct())
    if table:

        def told(batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
            letters, n = _letters(batch.column(col))
            text = np.repeat(np.arange(len(n)), n)
            lost = np.flatnonzero(~table.has[table.of(batch.column("font"))[text], table.places(letters)] & (letters != 32))
            once = lost[np.sort(np.unique((text[lost] << 21) | letters[lost], return_index=True)[1])]
            rows, begins = np.unique(text[once], return_index=True)
            each = pa.array(list(letters[once].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")), pa.string())
            return rows, [pa.ListArray.from_arrays(pa.array([*begins, len(once)], pa.int32()), each)]

        return _told(texts.select(*dict.fromkeys([*key, "font", col])), told, key, "missing array<string>")
    seen = letters_of(texts.select(*key, "font", F.col(col).alias("text"))).groupBy(*key, "font", "letter").agg(F.min("at").alias("at")).where("letter <> ' '")
    lost = seen.join(coverage.select(F.col("font_key").alias("font"), "letter"), ["font", "letter"], "left_anti")
    return lost.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]).alias("missing"))


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    """NFC; Spark has no built-in."""
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """NFD; Spark has no built-in."""
    return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def best_spelling(texts: DataFrame, coverage: DataFrame, key: list[str]) -> DataFrame:
    """Texts (key, font, text) with ``spelling``: as typed, composed or decomposed, the first their font lacks nothing of; else composed. ASCII texts have one spelling."""
    plain = F.col("text").rlike(r"^[\x00-\x7F]*$")
    ascii_, others = texts.where(plain).withColumn("spelling", F.col("text")), texts.where(~plain)
    forms = others.select(*key, "font", F.posexplode(F.array("text", composed("text"), decomposed("text"))).alias("form", "text"))
    lost = missing_letters(forms, coverage, [*key, "form"])
    rated = forms.join(lost, [*key, "form"], "left").withColumn("_lacks", F.col("missing").isNotNull())
    rank = F.struct("_lacks", F.when(F.col("_lacks"), F.when(F.col("form") == 1, 0).otherwise(1)).otherwise(F.col("form")).alias("r"))
    best = rated.groupBy(*key).agg(F.min_by("text", rank).alias("spelling"))
    return ascii_.unionByName(others.join(best, key))


def vouch_copies(copies: DataFrame, widths: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs of a document's copies of one font name (doc_id, name, font_key, kind, upright): whether the second may lend letters to the first, else why not.

    copy_stored_apart (another kind or writing mode), copy_too_few_shared (under 3 letters but spaces), copy_other_widths (one apart by more than 1).
    """
    a = copies.select("doc_id", "name", F.col("font_key").alias("own"), F.col("kind").alias("k1"), F.col("upright").alias("u1"))
    b = copies.select("doc_id", "name", F.col("font_key").alias("other"), F.col("kind").alias("k2"), F.col("upright").alias("u2"))
    pairs = a.join(b, ["doc_id", "name"]).where("own <> other")
    w1 = widths.where("letter <> ' '").select(F.col("font_key").alias("own"), "letter", F.col("width").alias("w1"))
    w2 = widths.where("letter <> ' '").select(F.col("font_key").alias("other"), "letter", F.col("width").alias("w2"))
    fonts = pairs.select("own", "other").distinct()
    shared = fonts.join(w1, "own").join(w2, ["other", "letter"]).groupBy("own", "other").agg(F.count("*").alias("n"), F.max(F.abs(F.col("w1") - F.col("w2"))).alias("apart"))
    told = F.when((F.col("k1") != F.col("k2")) | (F.col("u1") != F.col("u2")), "copy_stored_apart").when(F.coalesce("n", F.lit(0)) < p.copy_shared_letters, "copy_too_few_shared").when(F.col("apart") > p.copy_width_apart, "copy_other_widths")
    return pairs.join(shared, ["own", "other"], "left").select("doc_id", "name", "own", "other", told.alias("refusal"))


def pool_letters(copies: DataFrame, widths: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per (doc_id, name): which copy lends each letter. The first copy (by ``rank``) lends its own; each next joins only if its shared letters' widths agree with those pooled so far.

    Whether a copy joins depends on those that joined before, so one font's copies are walked together; a document has few.
    """
    held = copies.join(widths, "font_key").groupBy("doc_id", "name", "font_key", "rank").agg(F.collect_list(F.struct("letter", "width")).alias("letters"))

    def pool(key, group: pd.DataFrame) -> pd.DataFrame:
        pooled: dict[str, tuple[float, str]] = {}
        for row in group.sort_values(["rank", "font_key"]).itertuples():
            own = {x["letter"]: x["width"] for x in row.letters}
            shared = [c for c in own if c in pooled and c != " "]
            if pooled and (len(shared) < p.copy_shared_letters or any(abs(own[c] - pooled[c][0]) > p.copy_width_apart for c in shared)):
                continue
            pooled.update({c: (w, row.font_key) for c, w in own.items() if c not in pooled})
        return pd.DataFrame([(key[0], key[1], c, f) for c, (_, f) in sorted(pooled.items())], columns=["doc_id", "name", "letter", "lender"])

    return held.groupBy("doc_id", "name").applyInPandas(pool, "doc_id long, name string, letter string, lender string")


# Weight words in the order they are looked for.
WEIGHTS = [
    ("extralight", 200), ("ultralight", 200), ("extlt", 200), ("semilight", 350), ("demilight", 350), ("semibold", 600), ("demibold", 600), ("smbld", 600), ("extrabold", 800), ("ultrabold", 800),
    ("hairline", 100), ("thin", 100), ("light", 300), ("medium", 500), ("medm", 500), ("bold", 700), ("black", 900), ("heavy", 900), ("retina", 450), ("text", 450),
]


# Words that may end a spaced name and are its style, words of slanted cuts, and words that tell of another cut than regular or bold.
STYLE_WORDS = ["regular", "normal", "book", "bold", "italic", "oblique", "light", "medium", "semibold", "black"]
SLANTED_WORDS = ["italic", "oblique", "ital"]
CUT_WORDS = ["medi", "semi", "demi", "extra", "ultra", "narrow", "condensed", "wide"]


def normalise_fonts(fonts: DataFrame, col: str = "name") -> DataFrame:
    """Font names as ``family``, ``style``, ``weight``, ``bold`` (600 and up), ``slanted`` and ``usual`` (a regular or bold cut of plain width).

    What stands before the first + goes. The style is what follows the first dash, else the first comma, else the words at the end of a spaced name that are style words, the first word aside. A weight
    word in it decides, else the descriptor's (``listed``), else 400.
    """
    plain = F.regexp_replace(col, r"^[^+]*\+", "")
    words = rf"((?:\s+(?:{'|'.join(STYLE_WORDS)}))+)\s*$"
    spaced = F.regexp_extract(plain, rf"(?i)(?<=\S){words}", 0)
    before = F.when(F.contains(plain, F.lit("-")), F.substring_index(plain, "-", 1)).when(F.contains(plain, F.lit(",")), F.substring_index(plain, ",", 1))
    family = F.coalesce(before, F.left(plain, F.length(plain) - F.length(spaced)))
    after = F.when(before.isNotNull(), F.substr(plain, F.length(before) + 2)).otherwise(spaced)
    style = F.lower(F.regexp_replace(after, r"[^A-Za-z]", ""))
    weight = None
    for word, value in WEIGHTS:
        hit = F.contains(F.col("style"), F.lit(word))
        weight = F.when(hit, value) if weight is None else weight.when(hit, value)
    weight = F.coalesce(weight, F.col("listed"), F.lit(400))
    other = "|".join([*[w for w, v in WEIGHTS if v != 700], *CUT_WORDS])
    named = fonts.withColumn("family", family).withColumn("style", style).withColumn("weight", weight).withColumn("bold", weight >= 600)
    return named.withColumn("slanted", F.col("style").rlike("|".join(SLANTED_WORDS))).withColumn("usual", ~F.col("style").rlike(other))


def bare_family(family: Column) -> Column:
    """What a family is looked up by."""
    return F.lower(F.replace(family, F.lit(" ")))


def _style_rank(bold: Column, slanted: Column, b: Column, s: Column) -> Column:
    """How near a face's style is to the one asked for."""
    return F.when((bold == b) & (slanted == s), 0).when(bold == b, 1).when(slanted == s, 2).otherwise(3)


def look_alike(fonts: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each normalised font (font, name, family, bold, slanted, usual, kind) a shipped face (face: its name, family, bold, slanted, kind, plain, and ``same_widths``: the document fonts whose widths it has).

    In this order: the face of the font's exact name; the one face that lists the font's family, if just one does (a name that says the cut too); of the faces of that family, or that list it, the nearest style; the
    plain family of its kind (mono, serif, sans; sans if unknown). ``same_widths`` holds for exact and pinned faces, and for a usual cut of a known family in its own style.
    """
    c = catalog.select("face", F.col("family").alias("_family"), F.col("bold").alias("_b"), F.col("slanted").alias("_s"), F.col("kind").alias("_kind"), "plain", "same_widths")
    lent = c.select("face", "_b", "_s", F.explode("same_widths").alias("_name")).withColumn("_name", bare_family(F.col("_name"))).distinct()
    pinned = lent.groupBy("_name").agg(F.count_distinct("face").alias("_n"), F.first("face").alias("face"), F.first("_b").alias("_b"), F.first("_s").alias("_s")).where("_n = 1").drop("_n")
    known = c.select("face", "_b", "_s", bare_family(F.col("_family")).alias("_name")).unionByName(lent).distinct()
    f = fonts.withColumn("_k", F.coalesce("kind", F.lit("sans"))).withColumn("_name", bare_family(F.col("family")))
    tiers = [
        f.join(c.select("face", "_b", "_s"), F.col("name") == F.col("face")),
        f.join(pinned, "_name"),
        f.join(known, "_name"),
        f.join(c.where("plain").select("face", "_b", "_s", "_kind"), F.col("_k") == F.col("_kind")),
    ]
    columns = ["font", "bold", "slanted", "usual", "face", "_b", "_s"]
    every = None
    for tier, met in enumerate(tiers):
        t = met.select(*columns, F.lit(tier).alias("_tier"))
        every = t if every is None else every.unionByName(t)
    rank = F.struct("_tier", F.when(F.col("_tier") < 2, 0).otherwise(_style_rank(F.col("bold"), F.col("slanted"), F.col("_b"), F.col("_s"))).alias("r"), "face")
    own = (F.col("_tier") < 2) | ((F.col("_tier") == 2) & F.col("usual") & (F.col("bold") == F.col("_b")) & (F.col("slanted") == F.col("_s")))
    tier = F.get(F.array(*[F.lit(x) for x in ("exact", "pinned", "family", "plain")]), F.col("_tier"))
    return every.groupBy("font").agg(F.min_by(F.struct("face", tier.alias("found_by"), own.alias("same_widths")), rank).alias("x")).select("font", "x.*")


def choose_substitute(texts: DataFrame, faces: DataFrame, coverage: DataFrame, key: list[str]) -> DataFrame:
    """Per text (key, look_alike): its look-alike if that draws everything, else whichever of it and its broadest face (face, broadest) leaves out fewer letters; the look-alike on a tie."""
    each = texts.join(faces.select(F.col("face").alias("look_alike"), "broadest"), "look_alike", "left")
    both = each.select(*key, "text", F.posexplode(F.array_compact(F.array("look_alike", "broadest"))).alias("rank", "font"))
    seen = both.select(*key, "rank", "font", F.explode(F.array_distinct(F.split("text", ""))).alias("letter")).where("letter not in ('', ' ')")
    out = seen.join(coverage.select(F.col("font_key").alias("font"), "letter"), ["font", "letter"], "left_anti").groupBy(*key, "rank").agg(F.count("*").alias("left_out"))
    ranked = both.join(out, [*key, "rank"], "left").withColumn("left_out", F.coalesce("left_out", F.lit(0)))
    return ranked.groupBy(*key).agg(F.min_by(F.struct("font", "left_out"), F.struct("left_out", "rank")).alias("x")).select(*key, F.col("x.font").alias("face"), "x.left_out")


def catalog_file(fonts: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each font (font, family, weight, style): the catalogue's file of its weight and style, a static one first, else a variable one unless its name is reserved; else why not: no_family, no_style, reserved_name."""
    named = fonts.join(aliases.select(F.col("old").alias("family"), "new"), "family", "left").withColumn("_family", F.lower(F.coalesce("new", "family")))
    c = catalog.select(F.lower("family").alias("_family"), "path", F.col("weight").alias("_w"), F.col("style").alias("_st"), "static", "reserved")
    met = named.join(c, "_family", "left")
    fits = (F.col("_st") == F.col("style")) & ((F.col("_w") == F.col("weight")) | ~F.col("static"))
    usable = fits & (F.col("static") | ~F.col("reserved"))
    per = met.groupBy("font").agg(F.count("path").alias("n"), F.count_if(fits).alias("styles"), F.min_by(F.when(usable, F.col("path")), F.when(usable, F.struct((~F.col("static")).alias("v"), "path"))).alias("path"))
    return per.select("font", "path", F.when(F.col("path").isNotNull(), None).when(F.col("n") == 0, "no_family").when(F.col("styles") == 0, "no_style").otherwise("reserved_name").alias("reason"))


def substitute_width_delta(texts: DataFrame, widths: DataFrame, key: list[str]) -> DataFrame:
    """Per text (key, font, face) how much wider its letters are in the face, in %; null if a letter has no width in either or the font's are 0. Spaces aside. ``key`` tells one text.

    Where widths are few, each text is told by itself where it is; else letters meet widths in a join.
    """
    delta = F.when(F.col("lacks") | (F.col("own") == 0), None).otherwise(F.round((F.col("other") - F.col("own")) / F.col("own") * 100, 2)).alias("delta")
    table = width_table(widths)
    if table:
        t = texts.select(*dict.fromkeys([*key, "font", "face", "text"]))
        own = with_letter_sums(t, table, None).where("_letters > _spaces").withColumnsRenamed({"_sum": "own", "_unknown": "_lost"}).drop("_letters", "_spaces")
        both = with_letter_sums(own, table, None, font="face").withColumnRenamed("_sum", "other").withColumn("lacks", F.col("_lost") + F.col("_unknown") > 0)
        return both.select(*key, delta)
    n = letter_counts(texts, [*key, "font", "face"]).where("letter <> ' '")
    of = lambda k, c: widths.select(F.col("font_key").alias(k), "letter", F.col("width").alias(c))
    w = n.join(of("font", "own"), ["font", "letter"], "left").join(of("face", "other"), ["face", "letter"], "left")
    s = w.groupBy(*key).agg(F.sum(F.col("n") * F.col("own")).alias("own"), F.sum(F.col("n") * F.col("other")).alias("other"), F.bool_or(F.col("own").isNull() | F.col("other").isNull()).alias("lacks"))
    return s.select(*key, delta)


def coverage_runs(coverage: DataFrame) -> DataFrame:
    """Runs [first, last] of consecutive code points a font draws."""
    c = coverage.select("font_key", F.conv(F.hex(F.encode("letter", "UTF-32")), 16, 10).cast("long").alias("cp")).distinct()
    run = F.col("cp") - F.row_number().over(Window.partitionBy("font_key").orderBy("cp"))
    return c.withColumn("_run", run).groupBy("font_key", "_run").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).drop("_run")
