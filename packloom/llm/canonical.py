"""One form for text that looks the same, by DuckDB SQL inside Arrow partitions.

Two answers that look alike get one canonical string: invisible characters are removed by a regular expression, width
forms mapped by ``translate`` and accents composed by ``nfc_normalize``; then look-alikes, other compatibility forms and
ligatures are mapped and what that brings together is composed. Letter case, line breaks and wording stay.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.operators.skew import salted_join
from packloom.session import cut_lineage

# Letters of other scripts that have the shape of the Latin letter or the ideograph before the colon.
SAME_SHAPE = """
A: Α А Ꭺ
B: Β В
C: С Ϲ Ⅽ
D: Ⅾ
E: Ε Е Ꭼ
F: Ϝ
G: Ԍ
H: Η Н
I: Ι І Ⅰ Ӏ
J: Ј Ϳ
K: Κ К K
L: Ⅼ
M: Μ М Ⅿ
N: Ν
O: Ο О Օ
P: Ρ Р
Q: Ԛ
S: Ѕ Տ
T: Τ Т
V: Ѵ Ⅴ
W: Ԝ
X: Χ Х Ⅹ
Y: Υ Ү
Z: Ζ
a: а α ɑ
c: с ϲ ⅽ
d: ԁ ⅾ
e: е
g: ɡ
h: һ հ
i: і ⅰ ι
j: ј ϳ
k: κ
l: ӏ ⅼ
m: ⅿ
n: ո
o: о ο օ
p: р ρ
q: ԛ
s: ѕ
u: υ ս
v: ν ѵ ⅴ
w: ԝ ѡ
x: х ⅹ χ
y: у γ ү
μ: µ
-: ‐ ‑ ‒ − ﹣ ˗
': ʼ ʹ
·: ・ ‧ ∙ ⋅
:: ∶ ː
/: ∕ ⁄
~: ∼ 〜
"""

# Katakana that have the shape of an ideograph, and these ideographs.
KANA, KANA_AS = "ロエカニハタトミー", "口工力二八夕卜三一"

#: Spaces that are shown as the ordinary space.
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Format and filler characters, variation selectors and controls other than tab and line breaks.
INVISIBLE = (
    "[\\x{00}-\\x{08}\\x{0E}-\\x{1F}\\x{7F}-\\x{84}\\x{86}-\\x{9F}\\x{AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}"
    "\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF9}-\\x{FFFB}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E0FFF}]+"
)


def _same_shape() -> dict[str, str]:
    return {alike: latin for line in SAME_SHAPE.strip().splitlines() for latin, rest in [line.split(": ", 1)] for alike in rest.split()}


@functools.cache
def widths() -> dict[str, str]:
    """Full- and half-width forms, and all spaces -> the ordinary character."""
    out = {}
    for code in (*range(0xFF01, 0xFFEF), 0x3000):
        c = chr(code)
        whole = unicodedata.normalize("NFKC", c)
        if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) and len(whole) == 1:
            out[c] = whole
    out.update(dict.fromkeys(_SPACES, " "))
    return out


@functools.cache
def mapping() -> dict[str, str]:
    """Character -> the characters it is shown as, for composed text in ordinary width.

    From Unicode's font forms, radicals, letters and numerals of several characters, and SAME_SHAPE. What stands in a
    circle, raised, lowered or stacked, and what adds a space, looks different and stays.
    """
    same = _same_shape()
    out = dict(same)
    for code in range(0x80, 0x30000):
        c = chr(code)
        form = unicodedata.decomposition(c)
        if not form or c in same:
            continue
        kind = form.split()[0] if form[0] == "<" else ""
        whole = unicodedata.normalize("NFKC", c)
        radical = 0x2E80 <= code <= 0x2FDF or 0xF900 <= code <= 0xFAFF or 0x2F800 <= code <= 0x2FA1F
        joined = kind == "<compat>" and len(whole) > 1 and " " not in whole and not 0x2474 <= code <= 0x24B5 and not 0x3200 <= code <= 0x33FF and code < 0x1F100
        if kind in ("<font>", "<noBreak>") or radical or joined:
            shown = "".join(same.get(x, x) for x in whole)
        elif not kind:
            # A composed letter whose base has a look-alike: the look-alike with the same accents.
            parts = unicodedata.normalize("NFD", c)
            shown = unicodedata.normalize("NFC", same[parts[0]] + parts[1:]) if parts[0] in same else c
        else:
            continue
        if shown != c and c not in widths() and shown != unicodedata.normalize("NFC", c):
            out[c] = shown
    out["⺟"] = "母"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: list[str]) -> str:
    """A regular expression's class of the characters, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def _translated(x: str, table: dict[str, str]) -> str:
    return f"translate({x}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"


#: Runs of kana (and what stands between them), the ideographs beside which a run of look-alikes counts as ideographs.
_KANA_RUN, _HAN_AT_END, _HAN_AT_BEGIN = "[ぁ-ヿ]+|[^ぁ-ヿ]+", "[㐀-鿿]$", "^[㐀-鿿]"


@functools.cache
def canonical_steps() -> tuple[tuple[str, str], ...]:
    """The mapping step by step: DuckDB expressions over ``x``, each with the condition on ``x`` under which it is needed ('' for always)."""
    m = mapping()
    # translate() builds its table anew for each row: the short one, for the forms that most texts hold, always runs,
    # the others only where the text has one of their characters.
    short = {a: b for a, b in widths().items() if "\uff01" <= a <= "\uff5e"}
    narrow = {a: b for a, b in widths().items() if a not in short}
    one = {a: b for a, b in m.items() if len(b) == 1}
    several = {a: b for a, b in m.items() if len(b) != 1}
    has = lambda chars: f"regexp_matches(x, {_quoted(_class(list(chars)))})"
    pairs = ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in several.items())
    beside = f"(coalesce(regexp_matches(r[i - 1], '{_HAN_AT_END}'), false) OR coalesce(regexp_matches(r[i + 1], '{_HAN_AT_BEGIN}'), false))"
    run = f"CASE WHEN regexp_full_match(s, '[{KANA}]+') AND {beside} THEN translate(s, '{KANA}', '{KANA_AS}') ELSE s END"
    return (
        (f"regexp_replace(x, {_quoted(INVISIBLE)}, '', 'g')", ""),
        (_translated("x", short), ""),
        (_translated("x", narrow), has(narrow)),
        # Composed before letters are mapped, so that a letter keeps its marks.
        ("nfc_normalize(x)", ""),
        (f"nfc_normalize({_translated('x', one)})", has(one)),
        (f"nfc_normalize(array_to_string(list_transform(string_split(x, ''), lambda c: coalesce(MAP {{{pairs}}}[c], c)), ''))", has(several)),
        # A run of look-alike kana beside an ideograph is read as ideographs; other kana, and other words, keep theirs.
        (f"array_to_string(list_transform(r, lambda s, i: {run}), '')", f"regexp_matches(x, '[㐀-鿿][{KANA}]|[{KANA}][㐀-鿿]')"),
    )


@functools.cache
def canonical_query(source: str) -> str:
    """DuckDB query for all columns of ``source`` but ``raw``, and the canonical form of ``raw`` as ``canon``."""
    inner = f"SELECT * EXCLUDE (raw), raw AS x FROM {source}"
    for step, needed in canonical_steps():
        runs = f", CASE WHEN {needed} THEN regexp_extract_all(x, '{_KANA_RUN}') END AS r" if "list_transform(r" in step else ""
        inner = f"SELECT * EXCLUDE (x{', r' if runs else ''}), {f'CASE WHEN {needed} THEN {step} ELSE x END' if needed else step} AS x FROM (SELECT *{runs} FROM ({inner}))"
    return f"SELECT * EXCLUDE (x), x AS canon FROM ({inner})"


def _canonicalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    sql = canonical_query("batch")
    for b in batches:
        if not b.num_rows:
            continue
        batch = pa.Table.from_batches([b])  # noqa: F841 (read by name in the SQL)
        yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches()


def canonical_text(df: DataFrame, text: str, to: str = "canon") -> DataFrame:
    """``df`` with ``to``, the canonical form of ``text``; null stays null, the empty text stays empty.

    Other columns pass through unchanged. Whole texts are mapped, whatever their length.
    """
    others = [c for c in df.columns if c not in (text, to)]
    part = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("__raw"))
    names = [f"c{i}" for i in range(len(others))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, part.schema.fields)] + [T.StructField("canon", T.StringType())])
    mapped = part.toDF(*names, "raw").mapInArrow(_canonicalise, schema)
    return mapped.toDF(*others, to)


def equal_looking_pairs(df: DataFrame, group: str, id_col: str, text: str) -> DataFrame:
    """Pairs ``(id_a, id_b)``, ``id_a < id_b``, of rows of a group whose texts look the same but differ.

    Null texts, texts without a visible character and null groups give no pair. Equal strings are no pair. Rows are
    compared by digests of their canonical and raw forms, so no text is shuffled; groups that hold one spelling only
    leave before the join, and the rows of hot spellings are split over several tasks.
    """
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL AND g IS NOT NULL")
    canon = canonical_text(rows.withColumn("raw_md5", F.unhex(F.md5("t"))), "t")
    keyed = canon.where(F.col("canon").rlike(r"[^\s]")).select("id", F.unhex(F.md5(F.concat(F.encode("g", "UTF-8"), F.unhex(F.lit("00")), F.encode("canon", "UTF-8")))).alias("k"), "raw_md5")
    keyed = cut_lineage(keyed)  # digests only; the texts are read and mapped once
    several = keyed.groupBy("k").agg(F.min("raw_md5").alias("lo"), F.max("raw_md5").alias("hi")).where("lo <> hi").select("k")
    members = keyed.join(several, "k", "left_semi")
    other = members.select("k", F.col("id").alias("id_b"), F.col("raw_md5").alias("raw_b"))
    pairs = salted_join(members.select("k", F.col("id").alias("id_a"), "raw_md5"), other, "k", ["id_a"], "inner")
    return pairs.where("raw_md5 <> raw_b AND id_a < id_b").select("id_a", "id_b")
