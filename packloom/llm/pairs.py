"""Broken prompt and response pairs, each with its type of defect.

Copies are found by compressing the response with its prompt as a zstandard dictionary: a response that says nothing
but the prompt leaves almost nothing. Refusals and other languages are told by dictionaries, broken-off
responses by a terminal-context model fitted on complete reference answers.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.canonical import SAME_SHAPE
from packloom.operators.skew import salted_join

#: Contexts that a task counts before it hands the counts on.
MOST_CONTEXTS = 400_000
#: Lengths of the contexts, sightings a context needs to count, and the least share of endings among them.
CONTEXTS, SIGHTINGS, ENDING = (8, 6, 4, 3, 2, 1), 5, 0.1
#: Bytes that a copied response may leave after compression, beside a twelfth of its length.
LEFT = 40

# Phrases of a refusal; phrases that go with one; words that turn from a doubt to an answer; labels.
REFUSAL = """
无法确定 无法回答 无法判断 无法作答 无法得出 无法给出 无法提供 无法得知 不能回答 不能确定 不能判断 不能作答 不清楚 不知道 没提 没有提 未提及 未提供 未说明 无从 恕难
恕不 难以回答 难以判断 难以作答 拒绝 不作判断 不便作 不予 没有足够 证据不够 证据不足 依据不足 信息不足 材料不足 资料不足 不足以 超出可 超出范围 超出材料 超出资料 超出能力 给不出 没有写明 没有说明 抱歉 对不起 遗憾
""".split()
REFUSAL_EN = r"\b(?:cannot|can ?not|can['’]?t|could not|couldn['’]?t|unable|undetermined|undeterminable|not enough|insufficient|no answer|no conclusion|not possible|impossible|sorry|apologi[sz]e|declin\w+|refus\w+|do(?:es)? not (?:say|state|mention|know|tell|give|contain)|don['’]?t know|unknown|not (?:stated|given|known|clear)|as an? (?:ai|assistant|language model))\b"
POLITE = r"^(?:建议|请|如需|如有|欢迎|希望|作为|please|try|you may|feel free|as an? )"
TURN = r"但|然而|不过|可是|却|仍可|\bbut\b|\bhowever\b|\bstill\b|\byet\b|\bnevertheless\b|\bnonetheless\b"
LABELS = """
题目 问题 问 提问 题干 题 原题 答 回答 答案 如下 是 即 关于 重复 复述
thequestionis question questions q answer answers a the is prompt query task re repeat quote
""".split()
_LONGEST_FIRST = sorted(LABELS, key=len, reverse=True)

# Frequent short words of languages in Latin letters.
STOPWORDS = {
    "en": "the of and to in that which was were is are by with for from on at as before after led because would had not no this it its there has have did what who how when if between them came first followed".split(),
    "fr": "le la les un une des du de et à au aux en dans que qui a est sont par pour avec sur après avant ont été selon dossier directement plus ne pas ce cette il elle où".split(),
    "es": "el la los las un una unos de del y en que se por para con según al es son fue fueron causó tras después antes no lo su más como entre vecinos horas cabo".split(),
    "de": "der die das den dem des ein eine einer und in im zu von mit auf für ist sind war wurde nach vor laut aus bei es gab nicht sich folgt unmittelbar auch als wie durch über".split(),
    "pt": "o a os as um uma de do da dos das e em no na que se por para com segundo ao é são foi foram causou após depois antes não mais como entre horas".split(),
    "it": "il lo la i gli le un una di del della dei e in nel che si per con secondo al è sono fu dopo prima non più come tra fra ore ha causato".split(),
    "nl": "de het een en van in op te dat die is zijn was door met voor naar na volgens niet er als ook bij uit".split(),
    "vi": "của và là các có được trong cho không đã với này theo một những khi từ".split(),
}
_WORDS = {w: {lang for lang, ws in STOPWORDS.items() if w in ws} for ws in STOPWORDS.values() for w in ws}

_INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁯﻿︀-️]")
_SHAPES = str.maketrans({alike: latin for line in SAME_SHAPE.strip().splitlines() for latin, rest in [line.split(": ", 1)] for alike in rest.split() if latin.isascii() and latin.isalpha()})
_SENTENCES = re.compile(r"(?<=[。！？；!?;\n])|(?<=\.)(?=\s|$)")
_REFUSAL = re.compile("|".join(REFUSAL) + "|" + REFUSAL_EN, re.I)
_POLITE, _TURN = re.compile(POLITE, re.I), re.compile(TURN, re.I)
_EVENT = re.compile(r"D\d{2,}", re.I)
_BARE = re.compile(r"[\W_]+")
_NUMBERS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"[A-Za-z]*[0-9][A-Za-z0-9.]*|(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])")
_ALIKE = re.compile("[" + "".join(map(chr, _SHAPES)) + "]")
_LABEL = re.compile(r"(?m)^\s*[^：:。！？.!?\n]{1,24}[：:]")
_END, _CLOSE = "。！？.!?", "”’\"'」』)）】》*"
_OPEN = "，、：；,:;（(【「『“‘《<—-–→=+/…·"
_ANSWER = re.compile(r'"answer"\s*:\s*(null|"((?:[^"\\]|\\.)*)("?))', re.S)


def carried(raw: str) -> tuple[str | None, bool]:
    """What a raw reply carries as its answer, and whether the reply breaks off inside it.

    The reply may think aloud first, stand in a code fence, or be cut; a reply without a JSON object is its answer.
    """
    text = re.sub(r"<think>.*?(?:</think>|$)", "", raw, flags=re.S).strip()
    text = re.sub(r"^```\w*\s*|\s*```$", "", text)
    begin = text.find("{")
    if begin < 0:
        return text, False
    try:
        value = json.loads(text[begin : text.rfind("}") + 1])
        if isinstance(value, dict):
            answer = value.get("answer")
            return (answer if isinstance(answer, str) or answer is None else json.dumps(answer, ensure_ascii=False)), False
    except ValueError:
        pass
    found = _ANSWER.search(text, begin)
    if not found or found[1] == "null":
        return None, False
    body = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?$", "", found[2])
    try:
        return json.loads(f'"{body}"', strict=False), not found[3]
    except ValueError:
        return body, not found[3]


def plain(text: str) -> str:
    """One width, no invisible characters, no blanks around."""
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).strip()


def bare(text: str) -> str:
    """Letters and digits in one case."""
    return _BARE.sub("", text.translate(_SHAPES).casefold())


@functools.lru_cache(maxsize=2048)
def _compressor(prompt: str):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(1, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=17)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(prompt.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def copies(asked: str, said: str) -> bool:
    """Whether the response leaves next to nothing under the prompt's dictionary, and then nothing but labels."""
    prompt, response = bare(asked), bare(said)
    data = response.encode()
    if not prompt or len(_compressor(prompt).compress(data)) > LEFT + len(data) // 12:
        return False
    for form in (response, bare(_LABEL.sub("\n", said))):
        rest = form.replace(prompt, " ")
        if rest == form:
            continue
        for label in _LONGEST_FIRST:
            rest = rest.replace(label, " ")
        if not rest.strip():
            return True
    return False


def refuses(response: str) -> bool:
    """Whether the response declines and gives no answer beside it."""
    if not _REFUSAL.search(response):
        return False
    for sentence in _SENTENCES.split(response):
        if not sentence or not _TOKEN.search(sentence):
            continue
        if not _REFUSAL.search(sentence):
            if not _POLITE.match(sentence.strip()):
                return False
        elif _EVENT.search(sentence) or _TURN.search(sentence):
            return False
    return True


def _writing(text: str) -> Counter:
    out: Counter = Counter()
    for c in text:
        if "㐀" <= c <= "鿿":
            out["han"] += 1
        elif "぀" <= c <= "ヿ":
            out["kana"] += 1
        elif "가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ":
            out["hangul"] += 1
        elif c.isalpha():
            out["latin" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "other"] += 1
    return out


def _latin_word(found: re.Match) -> str:
    word = found[0].translate(_SHAPES)
    return word if all(c < "\u0250" for c in word) else found[0]


def language(text: str) -> str | None:
    """Language of a sentence; None where only names, ids and abbreviations stand.

    Words that are Latin but for letters of the same shape count as Latin.
    """
    if _ALIKE.search(text):
        text = _TOKEN.sub(_latin_word, text)
    text = _CODE.sub(" ", text)
    w = _writing(text)
    if not w:
        return None
    if w["kana"] >= 2 and w["kana"] * 8 >= w["kana"] + w["han"]:
        return "ja"
    if w["hangul"] >= 2:
        return "ko"
    if w["han"] and w["han"] * 3 >= w["latin"]:
        return "zh"
    if w["cyrillic"] > w["latin"]:
        return "ru"
    if w["other"] + w["greek"] > w["latin"]:
        return "other"
    words = [x.casefold() for x in _TOKEN.findall(text)]
    votes: Counter = Counter()
    for x in words:
        for lang in _WORDS.get(x, ()):
            votes[lang] += 1
    if not votes:
        return None if len(words) < 3 else "latin"
    best = max(votes.values())
    return "en" if votes["en"] == best else max(votes, key=lambda k: (votes[k], k))


def speaks_other(prompt: str, response: str) -> bool:
    """Whether most of the response's text is not in the prompt's language."""
    own = language(prompt)
    if own is None or own == "latin":
        return False
    right = wrong = 0
    for sentence in _SENTENCES.split(response):
        lang = language(sentence) if sentence else None
        if lang is None:
            continue
        size = len(_BARE.sub("", sentence))
        if lang == own or (lang == "latin" and own not in ("zh", "ja", "ko", "ru", "other")):
            right += size
        else:
            wrong += size
    return wrong > right


def _masked(text: str) -> str:
    """Ids and numbers in one form, so that contexts generalise; an id that lacks digits keeps them."""
    return _NUMBERS.sub("0", re.sub(r"D\d{3,}", "#", text))


def _count_contexts(text: str, name: bool, ends: Counter, goes_on: Counter) -> None:
    """Add the contexts of a complete text; of a name only those at its end count."""
    text = _masked(plain(text)) if name else _masked(plain(text).rstrip(_END + _CLOSE))
    if name:
        for n in CONTEXTS:
            if 2 <= n <= len(text):
                ends[text[-n:]] += 1
        return
    for i in range(1, len(text) + 1):
        for n in CONTEXTS:
            if n <= i:
                (ends if i == len(text) else goes_on)[text[i - n : i]] += 1


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(context, ends, goes_on)`` of rows ``(text, name)``; a context may come several times."""
    ends, goes_on = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        keys = list({**ends, **goes_on})
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([goes_on[k] for k in keys], pa.int64())], names=["context", "ends", "goes_on"])

    for b in batches:
        for text, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _count_contexts(text, name, ends, goes_on)
            if len(ends) + len(goes_on) > MOST_CONTEXTS:
                yield counted()
                ends.clear()
                goes_on.clear()
    yield counted()


class Endings:
    """How often a context ends a complete text, against how often the text goes on after it."""

    def __init__(self, ends: Counter, goes_on: Counter):
        keep = [k for k in {*ends, *goes_on} if ends[k] + goes_on[k] >= SIGHTINGS]
        self.share = {k: ends[k] / (ends[k] + goes_on[k]) for k in keep}

    @classmethod
    def fit(cls, references: list[str], names: list[str]) -> Endings:
        ends, goes_on = Counter(), Counter()
        for name, texts in ((False, references), (True, names)):
            for text in texts:
                _count_contexts(text, name, ends, goes_on)
        return cls(ends, goes_on)

    @classmethod
    def fit_all(cls, references: DataFrame, names: DataFrame) -> Endings:
        """``fit`` on every row of both, counted in tasks.

        Of the contexts only those reach the driver that decide otherwise than the next shorter one, or have none; the others change nothing.
        """
        texts = references.select("text", F.lit(False).alias("name")).unionByName(names.select("text", F.lit(True).alias("name"))).where("text IS NOT NULL")
        counts = texts.mapInArrow(_context_counts, "context string, ends bigint, goes_on bigint").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
        known = counts.where(F.col("ends") + F.col("goes_on") >= SIGHTINGS).withColumn("open", F.col("ends") / (F.col("ends") + F.col("goes_on")) < ENDING)
        size, shorter = F.length("context"), F.lit(None).cast("string")
        for n, less in zip(CONTEXTS, CONTEXTS[1:]):
            shorter = F.when(size == n, F.right("context", F.lit(less))).otherwise(shorter)
        rows = known.withColumn("shorter", shorter).join(known.select(F.col("context").alias("shorter"), F.col("open").alias("before")), "shorter", "left")
        kept = rows.where(F.col("before").isNull() | (F.col("before") != F.col("open"))).select("context", "ends", "goes_on").collect()
        return cls(Counter({r["context"]: r["ends"] for r in kept}), Counter({r["context"]: r["goes_on"] for r in kept}))

    def broken(self, text: str) -> bool:
        """Whether ``text`` (plain) breaks off."""
        text = text.rstrip()
        tail = text.rstrip(_CLOSE)
        if not tail:
            return False
        if tail[-1] in _END and not tail.endswith(("...", "。。。")):
            return False
        if tail[-1] in _OPEN or tail.endswith("..") or re.search(r"(?<![A-Za-z])D\d{0,2}$", tail):
            return True
        if sum(text.count(c) for c in "（(【「《“") > sum(text.count(c) for c in "）)】」》”"):
            return True
        if tail != text:
            return False  # a closed bracket or quotation
        masked = _masked(text)
        for n in CONTEXTS:
            share = self.share.get(masked[-n:]) if n <= len(masked) else None
            if share is not None:
                return share < ENDING
        return len(_BARE.sub("", text)) > 40


def defect(prompt: str | None, kind: str | None, answer: str | None, cut: bool, endings: Endings) -> str | None:
    """The defect of a pair, or None. ``kind`` is the prompt's type; a refusal of an unanswerable prompt is right."""
    text = plain(answer) if answer else ""
    own = bare(text)
    if not own:
        return "empty"
    asked = plain(prompt) if prompt else ""
    if asked and copies(asked, text):
        return "copies_question"
    shaped = text.translate(_SHAPES)
    if refuses(shaped) and kind != "unanswerable":
        return "refusal"
    if cut or endings.broken(shaped):
        return "truncated"
    if asked and speaks_other(asked, text):
        return "other_language"
    return None


def broken_pairs(attempts: DataFrame, questions: DataFrame, references: DataFrame, names: DataFrame) -> DataFrame:
    """``(delivery_id, defect_type)`` for each defective row of ``attempts``, repeats included.

    ``attempts(delivery_id, sample_key, answer, raw)``, ``questions(sample_key, question, kind)``: one row a sample, rows of
    more give the smallest. Where ``answer`` is null the raw reply's answer counts; where both are null the pair is
    ``empty``. Without a question (unknown sample, null key) copies and languages cannot be told and a refusal is a
    defect. ``references(key, text)`` and ``names(key, text)`` are complete texts, from all of which the terminal-context model is fitted.
    """
    spark = attempts.sparkSession
    fitted = spark.sparkContext.broadcast(Endings.fit_all(references, names))
    one = questions.where("sample_key IS NOT NULL").groupBy("sample_key").agg(F.min(F.struct("question", "kind")).alias("q"))
    rows = attempts.select("delivery_id", "sample_key", "answer", F.when(F.col("answer").isNull(), F.col("raw")).alias("raw"))
    pairs = salted_join(rows, one, "sample_key", ["delivery_id"], "left").select("delivery_id", "answer", "raw", "q.question", "q.kind")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = fitted.value
        for b in batches:
            ids, kinds = [], []
            for doc, answer, raw, question, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = False
                if answer is None and raw is not None:
                    answer, cut = carried(raw)
                found = defect(question, kind, answer, cut, endings)
                if found:
                    ids.append(doc)
                    kinds.append(found)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["delivery_id", "defect_type"])

    return pairs.mapInArrow(classify, "delivery_id bigint, defect_type string")
