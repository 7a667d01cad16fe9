"""Problem 1: question-answer pairs whose answer is broken, by noisy labelling functions and a label model.

For every defect some labelling functions vote for it, against it or not at all. A vote pattern of one defect
has at most 3^k forms, so that the table of pattern counts is small however many pairs there are; on it an
expectation-maximization model learns how far each function is to be trusted and gives each pattern a
posterior. A pair keeps every defect whose posterior exceeds that defect's cutoff, which is chosen on one half of
hand-labelled pairs and judged on the other. How answers end is learned from all answers: of each last pair of
characters (or word), hashed into a fixed number of cells, how often a text or sentence ends there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.codes import code_points
from kgloom.session import cut

CELLS = 1 << 20
DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Contents that only stand in for an answer.
STAND_INS = frozenset("null none nil nan na undefined todo tbd empty blank answer answeranswer a 空 空白 无 無 略 答 回答 答案 待补 待補 待填 待定 待续 未填 未答 暂无 暫無 暂无答案 暫無答案 暂缺 无内容 无答案 没有答案 noanswer notavailable notapplicable".split())
#: Whole answers to a question that can be answered by one word.
SHORT_ANSWERS = frozenset("可 不可 可以 不可以 能 不能 是 否 不是 有 无 無 没有 宜 不宜 忌 yes no none".split())
FINAL = "。！？!?．"
CLOSERS = "”’」』）)》〉】]}\"'"
OPEN_END = "，、：；,:;（([{《〈【“‘「『—-–·…+/&"

class Either:
    """A pattern of ideographs and one of Latin letters in lower case, which only texts with such letters are asked."""

    def __init__(self, han: str, latin: str) -> None:
        self.han, self.latin = re.compile(han), re.compile(latin)

    def __call__(self, text: str, low: str) -> bool:
        return bool(self.han.search(text) or low and self.latin.search(low))


_ASKS_SHORT = Either(r"可否|能否|是否|有无|有何|可不可|禁忌|吗|么", r"\b(?:can|may|is|are|does|should|any)\b")
#: Not being able or willing, and what is then not done; one within ten characters of the other declines.
_NOT = "恕难|难以|无法|無法|不能|不便|没法|没办法|没有办法|不方便|不予|拒绝|不会|不可以|不宜|不愿|不打算|未能|无权|不应|不该|不得|暂不|没有足够"
_TELL = "回答|作答|解答|答复|答覆|奉告|告知|告诉|给出|提供|判断|回应|讨论|处理|发表|评论|评价|协助|帮助|帮到|建议|说明|透露|就此|下结论|替您|资料|信息|意见"
_DECLINES = Either(
    rf"(?:{_NOT})[^，。；！？]{{0,10}}?(?:{_TELL})|(?:{_TELL})[^，。；！？]{{0,4}}(?:不了|不上|不便|不到)|帮不[上了]|答不[了上]|不适合由我|不由我|不在[^，。]{{0,6}}范围|超出[^，。]{{0,8}}(?:能力|范围|权限)|只能说到这里|不符合[^，。]{{0,6}}(?:规范|规定|政策|准则)|另请高明|爱莫能助",
    r"(?:\bcan(?:no|')?t|could not|couldn't|unable to|not able to|won't|will not|would rather not|prefer not to|not? allow|not allowed|not permitted|not in a position|must decline|have to decline|decline to|refuse to)\b.{0,40}?\b(?:help|answer|answered|give|given|provide|comment|assist|discuss|guidance|request|advise|advice|say|respond|share)|no comment|cannot be (?:answered|given)|request cannot|(?:beyond|outside) (?:my|the) (?:scope|ability)",
)
_APOLOGY = Either(r"对不起|抱歉|不好意思|很遗憾|恕我|请见谅|望谅解|请谅解|谢谢理解|敬请", r"\bsorry\b|apologi|regret|afraid")
_META = Either(r"语言模型|人工智能|助手|本系统|专业医师|专业人士|专家|另寻|请咨询|就诊|当面问|安全考虑|服务范围|您的请求", r"\bassistant\b|language model|guidelines|see a doctor|professional|\bas an ai\b|policy")
_DOSE = Either(r"\d+(?:\.\d+)? ?(?:克|毫升|钱|两|剂|日)|\d[gG]|\d[mM][lLgG]|《|主之|方用|先煎|归经|功在|忌[一-鿿]{4}", r"\d+(?:\.\d+)? ?(?:g|ml|mg|grams?|days?|minutes?|dias|jours|tage?|giorni)\b")
_ECHO_LABEL = re.compile(r"^(问题?|題目|题目|答案?|回答|您问的是|你问的是|您的问题是|原问|复述|question|q|answer|a|youasked)")
_PART = re.compile(r"(?:^|[；;|\n。，,\s])\s*([一-鿿]{2,4})\s*(?:[：:]|-)")
_TAG = re.compile(r"<[^<>]{0,20}>")
_WORD = re.compile(r"[A-Za-zÀ-ɏ']+$")
#: Words that join what follows, so that no sentence ends with them.
_DANGLING = re.compile(r"(?:和|与|或|及|跟|并|而|若|因|于|把|被|将|的|\b(?:the|an?|of|and|or|with|at|for|to|in|by))$")
_BLANKS = re.compile(r"[^\S\n]+")
_OPENING = re.compile("[（(\\[《〈【“「『]")
_LATIN, _MARKED, _FOREIGN = re.compile("[A-Za-z]{2}"), re.compile("[：:-]"), re.compile(r"[^\W\d_一-鿿]")
#: Frequent small words by language.
SMALL_WORDS = {
    "en": set("the is it at for of and with to be in are by should this that on from not no an as or which you was has".split()),
    "fr": set("le la les des une un est pendant et dans se puis du au avec pour pas ne sur qui que par ce il".split()),
    "de": set("der die das und mit man bei ist wird den dem danach am nicht ein eine zu von für auf im es sich".split()),
    "es": set("el los las se en una un luego por y de la con para que del no al es su lo".split()),
    "pt": set("o os a as à uma um e do da em não com para que depois no na por se".split()),
    "it": set("il gli la lo un una e di per poi alla con che non si del della da in le".split()),
}


_OTHER = re.compile(r"[\W_]+")


def content(text: str | None) -> str:
    """Letters, digits and ideographs only, folded."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text or "").casefold())


#: Letters of the scripts told apart.
SCRIPTS = {
    "han": "[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]",
    "kana": "[\u3040-\u30ff\uff66-\uff9f]",
    "hangul": "[\uac00-\ud7af\u1100-\u11ff]",
    "latin": "[A-Za-zÀ-ɏ]",
    "greek": "[\u0370-\u03ff]",
    "cyrillic": "[\u0400-\u052f]",
    "hebrew": "[\u0590-\u05ff]",
    "arabic": "[\u0600-\u06ff]",
    "devanagari": "[\u0900-\u097f]",
    "thai": "[\u0e00-\u0e7f]",
}
_SCRIPTS = {name: re.compile(x) for name, x in SCRIPTS.items() if name != "han"}
_HAN, _LETTER = re.compile(SCRIPTS["han"]), re.compile(r"[^\W\d_]")


def language(text: str | None) -> tuple[str, str, int]:
    """(language, script, letters). Ideographs count three times, as their words are shorter."""
    text = text or ""
    rest = _HAN.sub("", text)
    han = 3 * (len(text) - len(rest))
    letters = len(_LETTER.findall(rest))
    if 6 * letters < han or not letters:
        return ("zh", "han", han + letters) if han else ("", "", 0)
    counts = {name: len(x.findall(rest)) for name, x in _SCRIPTS.items()} if not rest.isascii() else {"latin": len(_SCRIPTS["latin"].findall(rest)), "kana": 0}
    counts["han"] = han
    total = sum(counts.values())
    if not total:
        return "", "", 0
    if counts["kana"] > 0.15 * total:
        return "ja", "kana", total
    script = max(counts, key=lambda k: counts[k])
    if script != "latin":
        return {"han": "zh", "hangul": "ko", "cyrillic": "ru"}.get(script, script), script, total
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    hits = {k: len(words & v) for k, v in SMALL_WORDS.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] >= 2 else "latin", script, total


def ending(text: str) -> str | None:
    """The last two characters, or the last word, before any mark; None without."""
    text = text.rstrip()
    m = _WORD.search(text)
    if m:
        return m[0].lower()
    tail = "".join(text[-12:].split())[-2:]
    return tail if tail and tail[-1].isalnum() else None


_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS = [pow(_MIX, i + 1, 1 << 64) for i in range(66)]


def _mixed(sums: np.ndarray) -> np.ndarray:
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(_MIX)
    return (sums >> np.uint64(40)).astype("i8") & CELLS - 1


def cell(end: str) -> int:
    """Cell of a character, a pair of characters or a word, as ``end_cells`` gives them."""
    total = 0
    for i, c in enumerate(end):
        total = (total + ord(c) * _POWERS[min(i, 65)]) & _MASK
    total ^= total >> 31
    return (total * _MIX & _MASK) >> 40 & CELLS - 1


def end_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all characters, pairs of characters and words of some texts, and whether a sentence or text ends there.

    White space doesn't count, and words of Latin letters stand for themselves only.
    """
    codes = code_points("\x00".join([*(t.lower() for t in texts), ""]))
    kind = kinds(codes)
    word, stop = (kind & _WORDED) > 0, (kind & _STOP) > 0
    power = np.multiply.accumulate(np.full(66, _MIX, "u8"))
    kept = (kind & (_WORDED | _SPACE)) == 0
    plain, alone = codes[kept].astype("u8"), (kind[kept] & _ALNUM) > 0
    stops = np.append(stop[kept][1:], True)
    pair = alone[1:] & (plain[:-1] != 0)
    begins = np.flatnonzero(word & ~np.append(False, word[:-1]))
    last = np.flatnonzero(word & ~np.append(word[1:], False))
    inside = np.flatnonzero(word)
    place = inside - np.repeat(begins, last - begins + 1)
    with np.errstate(over="ignore"):
        one = plain * power[0]
        two = plain[:-1] * power[0] + plain[1:] * power[1]
        long = np.add.reduceat(codes[inside].astype("u8") * power[np.minimum(place, 65)], np.searchsorted(inside, begins)) if len(begins) else np.zeros(0, "u8")
        cells = _mixed(np.concatenate([one[alone], two[pair], long]))
    return cells, np.concatenate([stops[alone], stops[1:][pair], np.append(stop | (codes == ord(".")), True)[last + 1]])


_KNOWN, _SPACE, _ALNUM, _WORDED, _STOP = 1, 2, 4, 8, 16
_kinds = np.zeros(0x110000, "u1")


def _kind(code: int) -> int:
    c = chr(code)
    letter = c == "'" or "a" <= c <= "z" or "\u00c0" <= c <= "\u024f"
    return _KNOWN | _SPACE * c.isspace() | _ALNUM * c.isalnum() | _WORDED * letter | _STOP * (c == "\x00" or c in FINAL)


def kinds(codes: np.ndarray) -> np.ndarray:
    """What each code point is; worked out once for each one met."""
    found = _kinds[codes]
    if not found.all():
        for code in np.unique(codes[found == 0]).tolist():
            _kinds[code] = _kind(code)
        found = _kinds[codes]
    return found


class Pair:
    """What labelling functions look at; each feature is worked out once."""

    def __init__(self, question: str, answer: str, ends: Callable[[str], tuple[float, float]]) -> None:
        self.question, self.answer, self.ends = question, answer, ends
        self.q, self.a = content(question), content(answer)
        self.bare = answer.rstrip()
        self.low = answer.lower() if _LATIN.search(answer) else ""

    @cached_property
    def short_answer(self) -> bool:
        """A whole answer of one word to a question that asks for one."""
        return self.a in SHORT_ANSWERS and _ASKS_SHORT(self.question, self.question.lower())

    @cached_property
    def inner(self) -> str:
        return content(_TAG.sub("", self.answer)) if "<" in self.answer else self.a

    @cached_property
    def stands_in(self) -> bool:
        if len(self.inner) > 24:
            return False
        rest = _ECHO_LABEL.sub("", self.inner)
        return not rest or bool({self.a, self.inner, rest} & STAND_INS) and not self.short_answer

    @cached_property
    def final(self) -> bool:
        """Ends with a final mark or a closing one."""
        text = self.bare
        return bool(text) and (text.rstrip(CLOSERS).rstrip()[-1:] in tuple(FINAL) or (text.endswith((".", "!", "?")) and not text.endswith("..")) or text[-1] in CLOSERS)

    @cached_property
    def echo(self) -> bool:
        """The question once or more, perhaps after a label, and nothing else."""
        if not self.a or not self.q or len(self.a) < len(self.q):
            return False
        return any(x in (self.q, self.q * 2, self.q * 3) for x in (self.a, _ECHO_LABEL.sub("", self.a, count=1)))

    @cached_property
    def parts(self) -> int:
        """Number of differently labelled parts, with white space or without it, which may stand inside a label or before one."""
        if not _MARKED.search(self.answer):
            return 0
        squeezed = _BLANKS.sub("", self.answer)
        return max(len({m[1] for m in _PART.finditer(t)}) for t in {self.answer, squeezed})

    @cached_property
    def declines(self) -> bool:
        return _DECLINES(self.answer, self.low)

    @cached_property
    def tells(self) -> bool:
        """Holds doses, works or effects, as answers of the domain do."""
        return _DOSE(self.answer, self.low)

    @cached_property
    def overlap(self) -> float:
        """Share of character pairs that question and answer have in common."""
        x, y = _grams(self.a), _grams(self.q)
        both = len(x & y)
        return both / max(1, len(x) + len(y) - both)

    @cached_property
    def tongues(self) -> tuple[tuple[str, str, int], tuple[str, str, int]]:
        return language(self.question), language(self.answer)

    @cached_property
    def no_answer(self) -> bool:
        """Nothing that could be cut off or be in another language: a stand-in, the question, a refusal or one word."""
        return self.stands_in or self.echo or self.a in self.q or self.declines and not self.tells or self.a in SHORT_ANSWERS


def _grams(s: str) -> set[str]:
    return set(zip(s, s[1:], strict=False)) or {(s,)}


def _sign(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _end_vote(p: Pair) -> int:
    """Whether other texts and sentences end like this one: by its last word or two characters, as far as these are known, and by the last one."""
    if p.final or len(p.a) < 2 or p.parts > 1:  # labelled parts come in any order, and any of their values may be the last
        return 0
    end = ending(p.answer)
    if end is None:
        return 0
    whole, last = p.ends(end), p.ends(end) if _WORD.search(end) else p.ends(end[-1])
    if last[1] < 4:
        return 0
    others = max(0.0, last[0] * last[1] - 1) / (last[1] - 1)  # this text's own end is no evidence
    share = (max(0.0, whole[0] * whole[1] - 1) + 10 * others) / (max(0.0, whole[1] - 1) + 10)
    return _sign(share < 0.02, share > 0.06)


def _open_brackets(p: Pair) -> int:
    tail = p.answer[-14:]
    if not _OPENING.search(tail):
        return -1
    opened = max(tail.rfind(c) for c in "（([《〈【“「『")
    return _sign(not any(c in CLOSERS for c in tail[opened + 1 :]), True)


def _open_end(p: Pair) -> int:
    return _sign(len(p.a) > 1 and (p.bare[-1:] in tuple(OPEN_END) or p.bare.endswith("..") or bool(_DANGLING.search(p.bare))), True)


def _labelled(p: Pair) -> int:
    if p.parts < 2 and not (p.parts and re.match(r"\s*[一-鿿]{2}[：:]", p.answer)):
        return 0
    return _sign(p.parts < 4 and not p.final, p.parts >= 4 and p.bare[-1:] not in tuple(OPEN_END))


def _differ(p: Pair, of: int) -> int:
    """Whether language (0) or script (1) of question and answer differ; short answers and unknown languages tell nothing."""
    if not (p.low or _FOREIGN.search(p.a) or _FOREIGN.search(p.q)):
        return -1
    asked, said = p.tongues
    if not asked[of] or said[2] < 8:
        return -1
    if of == 0 and "latin" in (asked[0], said[0]) and asked[1] == said[1]:
        return 0
    return _sign(asked[of] != said[of], True)


def _unless(test: Callable[[Pair], bool], vote: Callable[[Pair], int]) -> Callable[[Pair], int]:
    """A function that is against the defect wherever the test excludes it."""
    return lambda p: -1 if test(p) else vote(p)


def _whole(p: Pair) -> bool:
    return p.no_answer


def _said_before(p: Pair) -> bool:
    return p.echo or p.stands_in


#: Functions of a defect look at different things, so that none repeats another: what one excludes by definition,
#: such as a cut-off stand-in, it is itself against.
FUNCTIONS: dict[str, tuple[Callable[[Pair], int], ...]] = {
    "empty": (
        lambda p: _sign(not p.a, True),
        lambda p: _sign(p.stands_in, len(p.inner) > 4),
        lambda p: _sign(len(p.inner) <= 2 and not p.short_answer, len(p.inner) > 4 or p.short_answer),
        lambda p: _sign(not p.tells and p.overlap <= 0.1, True),
    ),
    "truncated": (
        _unless(_whole, _open_end),
        _unless(_whole, _open_brackets),
        _unless(_whole, _end_vote),
        _unless(_whole, lambda p: _sign(not p.final, True)),
        _unless(_whole, _labelled),
    ),
    "refusal": (
        _unless(_said_before, lambda p: _sign(p.declines, True)),
        _unless(_said_before, lambda p: _sign(_APOLOGY(p.answer, p.low), True)),
        _unless(_said_before, lambda p: _sign(_META(p.answer, p.low), True)),
        _unless(_said_before, lambda p: _sign(not p.tells, True)),
    ),
    "copied_question": (
        lambda p: _sign(p.echo, True),
        lambda p: _sign(len(p.q) > 3 and p.overlap > 0.85, p.overlap < 0.7),
        lambda p: _sign(len(p.q) > 3 and p.a[-6:] == p.q[-6:], p.a[-6:] != p.q[-6:]),
    ),
    "other_language": (
        _unless(_whole, lambda p: _differ(p, 0)),
        _unless(_whole, lambda p: _differ(p, 1)),
        _unless(_whole, lambda p: _sign(len(p.a) > 20 and p.overlap < 0.05, p.overlap > 0.2)),
    ),
}

#: Hand-labelled pairs for the cutoffs: question, answer, defects.
VALIDATION: tuple[tuple[str, str | None, str], ...] = (
    ("桂枝汤由哪些药组成？", None, "empty"),
    ("桂枝汤由哪些药组成？", "  ", "empty"),
    ("桂枝汤由哪些药组成？", "……", "empty"),
    ("桂枝汤由哪些药组成？", "暂无答案", "empty"),
    ("桂枝汤由哪些药组成？", "（空）", "empty"),
    ("桂枝汤由哪些药组成？", "N/A", "empty"),
    ("服桂枝汤有何禁忌？", "无。", ""),
    ("可否用桂枝汤？", "可", ""),
    ("可否用桂枝汤？", "不可。", ""),
    ("出自何书？", "《伤寒论》", ""),
    ("桂枝汤由哪些药组成？", "桂枝9g、芍药9g、甘草6g、", "truncated"),
    ("桂枝汤由哪些药组成？", "桂枝9g、芍药9g，水煎温服，每服", "truncated"),
    ("桂枝汤由哪些药组成？", "桂枝汤载于《伤寒论》，以桂枝9g配", "truncated"),
    ("桂枝汤由哪些药组成？", "桂枝9g、芍药9g、甘草6g，水煎温服，每服200ml，3日为度", ""),
    ("桂枝汤由哪些药组成？", "桂枝9g、芍药9g，水煎温服，每服200ml（Guizhi Tang）", ""),
    ("How should it be taken for the cough?", "Take it warm, 9 grams at", "truncated"),
    ("How should it be taken for the cough?", "Take it warm, 9 grams at dusk, for 3 days.", ""),
    ("桂枝汤由哪些药组成？", "抱歉，我无法回答这个问题。", "refusal"),
    ("桂枝汤由哪些药组成？", "作为语言模型，我不能提供用药建议，请咨询专业医师。", "refusal"),
    ("桂枝汤由哪些药组成？", "I'm sorry, but I can't help with that.", "refusal"),
    ("How should it be taken for the cough?", "Sorry, I am unable to give guidance on this.", "refusal"),
    ("桂枝汤由哪些药组成？", "对不起，前人所述有误：桂枝汤不宜骤进，先以甘草9g试之，待3日再议。", ""),
    ("此证如何辨治？", "此为虚证，不能峻补，桂枝汤主之。", ""),
    ("桂枝汤由哪些药组成？", "桂枝汤由哪些药组成？", "copied_question"),
    ("桂枝汤由哪些药组成？", "问题：桂枝汤由哪些药组成", "copied_question"),
    ("桂枝汤由哪些药组成？", "桂枝汤由哪些药组成？桂枝汤由哪些药组成？", "copied_question"),
    ("某人得病，可否用桂枝汤？", "某人得病，可否用桂枝汤？答曰：水煎温服，每服100ml，3日为度。", ""),
    ("桂枝汤由哪些药组成？", "La formule se prend tiède, 9 grammes le soir, puis on se repose.", "other_language"),
    ("桂枝汤由哪些药组成？", "The recipe is taken warm, 9 grams in the evening, followed by rest.", "other_language"),
    ("桂枝汤由哪些药组成？", "空腹時に9日つづけ、冷たいものを避けること。", "other_language"),
    ("How should it be taken for the cough?", "桂枝汤主之，水煎温服，每服200ml，3日为宜。", "other_language"),
)


def end_statistics(pairs: DataFrame) -> np.ndarray:
    """(2, CELLS): how often each cell occurs in all answers, and how often a sentence or text ends there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CELLS), "i8")
        for b in batches:
            cells, stops = end_cells([t or "" for t in b["answer"]])
            total += np.stack([np.bincount(cells, minlength=CELLS), np.bincount(cells[stops], minlength=CELLS)])
        on = np.flatnonzero(total[0])
        yield pd.DataFrame({"cell": on, "n": total[0, on], "ends": total[1, on]})

    out = np.zeros((2, CELLS), "i8")
    rows = pairs.select("answer").mapInPandas(run, "cell long, n long, ends long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).toPandas()
    out[:, rows["cell"]] = rows["n"], rows["ends"]
    return out


def votes_of(question: str | None, answer: str | None, ends: Callable[[str], tuple[float, float]]) -> dict[str, str]:
    """Vote pattern of each defect: one of '+', '-', '0' for each labelling function."""
    p = Pair(question or "", answer or "", ends)
    return {d: "".join(["0+-"[f(p)] for f in fs]) for d, fs in FUNCTIONS.items()}


def _lookup(stats: np.ndarray) -> Callable[[str], tuple[float, float]]:
    def ends(end: str) -> tuple[float, float]:
        k = cell(end)
        return stats[1, k] / max(1, stats[0, k]), float(stats[0, k])

    return ends


def vote(pairs: DataFrame, stats: np.ndarray) -> DataFrame:
    """(source_table, record_id, defect, pattern) of every pair and defect."""
    shared = pairs.sparkSession.sparkContext.broadcast(stats)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = _lookup(shared.value)
        for b in batches:
            patterns = [votes_of(q, a, ends) for q, a in zip(b["question"], b["answer"], strict=True)]
            yield pd.DataFrame({"source_table": b["source_table"], "record_id": b["record_id"]} | {d: [p[d] for p in patterns] for d in DEFECTS})

    wide = pairs.select("source_table", "record_id", "question", "answer").mapInPandas(run, "source_table string, record_id string, " + ", ".join(f"{d} string" for d in DEFECTS))
    return wide.select("source_table", "record_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("v")).select("source_table", "record_id", "v.*")


#: Where expectation-maximization starts: how many times as likely each function's vote for, or against, is thought to be right as to be wrong.
TRUST: dict[str, tuple[tuple[float, float], ...]] = {
    "empty": ((1000, 2), (300, 50), (10, 3), (3, 50)),
    "truncated": ((100, 1.5), (10, 1.05), (20, 5), (8, 50), (30, 10)),
    "refusal": ((300, 50), (20, 2), (20, 2), (3, 100)),
    "copied_question": ((500, 50), (50, 50), (10, 5)),
    "other_language": ((100, 100), (50, 5), (3, 20)),
}


def label_model(counts: dict[str, int], trust: tuple[tuple[float, float], ...], rounds: int = 200, firm: float = 0.5) -> dict[str, float]:
    """Posterior of the defect for each pattern, by expectation-maximization that starts from the trust.

    Votes are taken as independent given the truth, and not to vote says nothing. The trust is also a prior of
    ``firm`` times the weight of the votes, so that votes count the more, and alike at every size. Two things keep the
    classes what they are called: the defect is the rarer class, and a vote for it never makes it less likely, nor
    one against it more likely. Where a ratio is 1e5 or more, that a pair with the defect gets no such wrong vote is a rule and not learned.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    code = np.array([["0+-".index(c) for c in p] for p in patterns])
    plus, minus = np.array(trust, float).T
    alarm = np.clip((minus - 1) / (plus * minus - 1), 1e-4, 1 - 1e-4)  # how often a function is for the defect without it, from both ratios
    hit = np.clip(plus * alarm, 1e-4, 1 - 1e-7)
    belief = np.stack([np.stack([alarm, 1 - alarm], 1), np.stack([hit, 1 - hit], 1)], 1)  # truth: no, yes; votes: for, against
    fixed = np.array([max(votes) >= 1e5 for votes in trust])
    table, prior, post = belief.copy(), np.array([0.97, 0.03]), np.zeros(len(n))
    for _ in range(rounds):
        odds = sum(np.where(code[:, j] > 0, np.log(table[j, 1] / table[j, 0])[code[:, j] - 1], 0.0) for j in range(code.shape[1]))
        new = 1 / (1 + np.exp(np.clip(-np.log(prior[1] / prior[0]) - odds, -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
        mass = np.stack([(1 - post) * n, post * n])
        share = min(0.5, (mass[1].sum() + 0.6) / (mass.sum() + 20))
        prior = np.array([1 - share, share])
        seen = np.stack([np.stack([(mass * (code[:, j] == v)).sum(1) for v in (1, 2)], 1) for j in range(code.shape[1])])
        seen += belief * (firm * seen.sum(2, keepdims=True) + 1)
        table = seen / seen.sum(2, keepdims=True)
        pooled = seen.sum(1) / seen.sum((1, 2))[:, None]
        wrong = table[:, 1, 0] < table[:, 0, 0]  # a function that contradicts its name says nothing
        table[wrong] = pooled[wrong, None, :]
        table[fixed, 1] = belief[fixed, 1]
    return dict(zip(patterns, post.tolist(), strict=True))


def validated_cutoff(defect: str, posterior: dict[str, float], ends: Callable[[str], tuple[float, float]]) -> float:
    """The cutoff with the best F1 on the hand-labelled pairs; of equal ones the one nearest to a half."""
    truth = [(votes_of(q, a, ends)[defect], defect in d.split()) for q, a, d in VALIDATION]
    best = (-1.0, 0.0, 0.5)
    for c in np.arange(0.2, 0.81, 0.05):
        said = [(posterior.get(p, _nearest(p, posterior)) > c, t) for p, t in truth]
        right, wrong = sum(s and t for s, t in said), sum(s != t for s, t in said)
        best = max(best, (2 * right / max(1, 2 * right + wrong), -abs(c - 0.5), float(c)))
    return best[2]


def _nearest(pattern: str, posterior: dict[str, float]) -> float:
    """For a pattern that no pair had: the mean of the most similar ones."""
    near = max((sum(a == b for a, b in zip(pattern, p, strict=True)) for p in posterior), default=0)
    same = [v for p, v in posterior.items() if sum(a == b for a, b in zip(pattern, p, strict=True)) == near]
    return float(np.mean(same)) if same else 0.0


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(source_table, record_id, defect, posterior) of ``pairs`` (source_table, record_id, question, answer).

    A pair may have several defects and then several rows. Null questions and answers are read as ''.
    Repeated rows give one row each defect; no pairs, no rows.
    """
    spark: SparkSession = pairs.sparkSession
    stats = end_statistics(pairs)
    voted = cut(vote(pairs, stats))
    counts: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in voted.groupBy("defect", "pattern").count().toLocalIterator():
        counts[r["defect"]][r["pattern"]] = r["count"]
    ends = _lookup(stats)
    rows = []
    for d in DEFECTS:
        posterior = label_model(counts[d], TRUST[d])
        cutoff = validated_cutoff(d, posterior, ends)
        rows += [(d, p, v) for p, v in posterior.items() if v > cutoff]
    chosen = spark.createDataFrame(rows, "defect string, pattern string, posterior double")
    return voted.join(F.broadcast(chosen), ["defect", "pattern"]).groupBy("source_table", "record_id", "defect").agg(F.max("posterior").alias("posterior"))
