"""Problem 10: personal information in free text, found by boosted trees over generated candidates.

Generators of high recall propose overlapping spans of five types. Each span is described by its format and
by its context; one boosted model a type, trained on a bounded sample, gives a calibrated probability, and
the type's cutoff, chosen on held-out spans, decides. Of overlapping spans the most probable stays. There are
no labelled rows, so that the sample is labelled by narrow rules: a span with a full format and a cue beside it
is one, a span beside a cue of something else or of an impossible format is none, and the rest is left out of
training. Spans that the rules leave open are decided by the model alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.boosting import Boosted

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

#: Common single surnames and compound ones.
SINGLE_SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫房裘缪丁宣邓郁单杭洪包诸左石崔吉钮龚程邢裴陆荣翁荀羊甄曲家封储靳松井段富巫乌焦巴弓牧隗山谷车侯全班仰秋仲伊宫宁仇栾甘厉祖武符刘景詹束龙叶幸司黎薄白蒲从索赖卓蔺屠蒙池乔阴胥闻党翟谭贡姬申扶堵冉宰雍璩桑桂濮牛寿通边扈燕冀尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷辛阚那简饶空曾沙养鞠丰关蒯相查荆红游竺权盖益桓公"
)
COMPOUND_SURNAMES = "欧阳 司马 司徒 上官 诸葛 东方 东郭 南宫 西门 夏侯 慕容 令狐 皇甫 尉迟 公孙 长孙 宇文 轩辕 百里 端木 独孤 拓跋 申屠 太史 公冶 濮阳 淳于 单于 钟离 闻人 赫连 澹台 鲜于 闾丘 司空 亓官 仲孙 公羊".split()

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}
_AT = r"(?:@|\((?:at|AT|At)\)|\[(?:at|AT|At)\]|\{(?:at|AT|At)\}|#at#)"
_DOT = r"(?:\.|[ ]?(?:\((?:dot|DOT|Dot)\)|\[(?:dot|DOT|Dot)\]|\{(?:dot|DOT|Dot)\})[ ]?)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*[ ]?{_AT}[ ]?[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*|(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]* at [A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)+")
_AT_SIGN = re.compile(_AT)
_TAIL = r"(?:[ ]?(?:转|分机|ext\.?|x|#)[ ]?\d{1,6})?"
_PHONES = (
    re.compile(rf"(?<![\d\-.])(?:\+?86[ \-]?)?1[3-9]\d([ \-.]?)\d{{4}}\1\d{{4}}(?![\d\-]|\.\d){_TAIL}"),
    re.compile(rf"(?<![\d\-.])(?:\+?86[ \-]?)?(?:\(0\d{{2,3}}\)|0\d{{2,3}})[ \-]?\d{{3,4}}[ \-]?\d{{4}}(?![\d\-]|\.\d){_TAIL}"),
    re.compile(rf"(?<![\d\-.])(?:\+?\d{{1,3}}[ \-.]?)?(?:\(\d{{3}}\)|\d{{3}})[ \-.]?\d{{3}}[ \-.]\d{{4}}(?![\d\-]|\.\d){_TAIL}"),
    re.compile(rf"(?<![\d\-.+])\d{{3,4}}[ \-.]\d{{4}}(?![\d\-]|\.\d){_TAIL}"),
    re.compile(rf"(?<![\d\-.])\+?\d{{7,13}}(?![\d\-]|\.\d){_TAIL}"),
    re.compile(rf"(?<![\d\-.])\+\d{{1,3}}(?:[ \-.]\(?\d{{1,4}}\)?){{2,5}}(?![\d\-]|\.\d){_TAIL}"),
)
#: Numbers that are phones by their form alone: mobile ones, those with an area code, and international ones.
_FULL_PHONE = re.compile(rf"(?:(?:\+?86[ \-]?)?1[3-9]\d([ \-.]?)\d{{4}}\1\d{{4}}|(?:\(0\d{{2,3}}\)|0\d{{2,3}})[ \-]?\d{{3,4}}[ \-]?\d{{4}}|\+\d{{1,3}}(?:[ \-.]\(?\d{{1,4}}\)?){{2,5}}){_TAIL}")
#: A digit and a separator in front: the number is the rest of a longer one.
_GOES_ON = re.compile(r"\d[ \-]$")
_IDS = (
    re.compile(r"(?<![\d\-A-Za-z])\d{6}([ \-]?)\d{8}\1\d{3}[\dXx](?![\dA-Za-z\-])"),
    re.compile(r"(?<![\d\-A-Za-z])\d{6}([ \-]?)\d{8}\1\d{3}[\dXx](?![\d\-])"),
    re.compile(r"(?<![\dA-Za-z\-])[A-Z]{1,2}[ ]?\d{6,9}(?![\d\-])"),
    re.compile(r"(?<![\d\-A-Za-z])\d{15,20}(?![\d\-])"),
)
_HAN = "[一-鿿]"
_NUM = "(?:[0-9]+|[〇零一二三四五六七八九十百]+)"
_ROAD = rf"{_HAN}{{2}}(?:大道|胡同|路|街|巷|弄|里|村|屯|庄)"
_PLACE_END = "省市县区镇乡州盟旗"
_HOUSE_NO = f"[甲乙丙丁附特临]?{_NUM}[甲乙丙丁A-Za-z]?(?:[-之]{_NUM})*号(?:之{_NUM}|附{_NUM}号)?"
#: The end of a road's name and all that follows; where the address starts is left to overlapping candidates.
_ZH_HOUSE = re.compile(rf"(?:(?<=大)道|(?<=胡)同|[路街巷弄里村屯庄])(?:{_NUM}组)?(?:{_NUM}弄)?{_HOUSE_NO}(?:院|楼)?(?:{_NUM}(?:号楼|栋|幢))?(?:{_NUM}单元)?(?:{_NUM}[楼层])?(?:{_NUM}室)?")
#: The most ideographs of a place's name, of a road's, and what stands before an address, surely or perhaps.
PLACE_LENGTH, ROAD_LENGTH = 14, 8
_ZH_CUE = re.compile(r"(?:家住|现住|住在|居住在|住址|地址|寓居|现寓|寓居于|送至|送到|寄至|寄到|寄往|位于|坐落于|住|寓)[为是：: ]*$")
_ZH_MAYBE = re.compile(r"[在于至到往是为由从距离]$")
_ZH_NOT_NAME = re.compile(r"[在于至到往是为由从住寓我他她你其]")
_ZH_PLACE = re.compile(rf"(?:{_HAN}{{2}}(?:省|市|县|区|镇|乡))+(?:{_ROAD})?|{_ROAD}")
_EN_ROAD = r"(?:Road|Close|Street|Lane|Avenue|Way|Drive|Court|Place|Square|Terrace|Row|Rd|St|Ave)"
_EN_ADDRESS = re.compile(rf"(?<![\d\-])\d{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+ ){{1,4}}{_EN_ROAD}\b\.?(?:, (?:[A-Z][a-z]+(?: [A-Z][a-z]+)?))*")
_EN_PLACE = re.compile(rf"\b(?:[A-Z][a-z]+ ){{1,3}}(?:{_EN_ROAD}|Bend|Gate|Kiln)\b")
_SURNAME = "(?:" + "|".join(COMPOUND_SURNAMES) + f"|[{SINGLE_SURNAMES}])"
#: What stands before and after a person's name.
_NAME_BEFORE = r"(?:姓名|记录人|抄者|抄写人|其[母父妻夫子女兄弟姊妹]|另有|[条费]由|药费由|写着|病家|病人|患者|是日|联系人|收件人|经手人?|署名|签名|家属|代诉人)[：: ]{0,2}"
_NAME_AFTER = r"(?:携|谨识|谨记|代述|代诉|同来|同行|口述|垫付|自述|来诊|[，,]年|[，,]下|先生|女士|[；;）)]|[。\n])"
_BEFORE = re.compile(_NAME_BEFORE + "$")
_AFTER = re.compile(_NAME_AFTER)
_ZH_CUED = re.compile(rf"(?={_NAME_BEFORE}(?P<full>{_HAN}{{2,4}}))|(?:^|(?<=[。！？\n 　]))(?P<open>{_SURNAME}{_HAN}{{1,2}})(?=[，,](?:年|下))|(?P<late>{_SURNAME}{_HAN}{{1,2}})(?=携|谨识|代述|同来|口述|垫付|自述|[，,]年[一二三四五六七八九十])")
_EN_NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+(?:-[A-Z][a-z]+)?")
_NO_FIRST = frozenset("As The A An Compare Dried Take When On No Do Season Physicians She He It Call Phone Tel Write Contact Resident Patient Ledger Lot Identity Document In At By For And But Or If This That".split())
_EN_BEFORE = re.compile(r"(?:Patient:|signed by|As|by|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Dear|name:|Name:|from|witness)\s+$")
_EN_AFTER = re.compile(r"\s*(?:recalled|said|wrote|reported|told|asked|signed|came|paid)\b")

_PHONE_CUE = re.compile(r"(电话|手机|座机|热线|短信|留号|联系|拨打?|致电|传真|来电|Tel|Phone|Call|Mobile|Fax|Contact|tel|phone|call)[：:. （(]*$")
_ID_CUE = re.compile(r"(身份证号?码?|身份号码为?|证件号?码?|护照(或证件)?号?码?|护照|Identity no\.|Document shown|Passport( no\.)?|ID( no\.)?|identity (no|number)\.?|passport)[：: （(为]*$", re.I)
_ADDRESS_CUE = re.compile(r"(地址|住址|家住|现寓|寓居|住在|住|送至|寄至|寄往|寓|Resident at|went to|lives at|Address:?|address:?|living at|at|to)[：: ]*$")
_MAIL_CUE = re.compile(r"(电邮|邮箱|邮件|信至|请寄|发往|Write to|Contact|E-?mail|Email|mail)[：: ]*$", re.I)
_OTHER_CUE = re.compile(r"(编号|第|银|藏书号|序号|记数|共|Lot|entry|Ledger entry|Ledger|页|卷|方账|方笺编号|号码牌|No\.|vol\.|p\.)[：: ]*$")
_UNIT_AFTER = re.compile(r"^\s*(粒|文|页|叶|钱|两|片|剂|枚|分|年|月|日|次|parts|lists|grams|months)")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def flat(text: str) -> str:
    """Full-width signs as ASCII, place by place, so that offsets stay."""
    return text.translate(_WIDE)


def candidates(text: str, plain: str) -> list[Span]:
    """Overlapping spans of all types."""
    found: set[Span] = set()
    add = lambda kind, m, g=0: found.add(Span(kind, m.start(g), m.end(g)))
    if "@" in plain or "at" in plain or "AT" in plain:
        for m in _EMAIL.finditer(plain) if _AT_SIGN.search(plain) or " at " in plain else ():
            add("email", m)
    if re.search(r"\d", plain):
        for kind, patterns in (("phone", _PHONES), ("id_number", _IDS)):
            for p in patterns:
                for m in p.finditer(plain):
                    add(kind, m)
                    if kind == "phone" and m[0][0] == "+" and " " in m[0]:
                        found.add(Span(kind, m.start() + m[0].index(" ") + 1, m.end()))
        for m in _EN_ADDRESS.finditer(plain):
            add("address", m)
    for m in _ZH_HOUSE.finditer(plain):
        found.update(Span("address", a, m.end()) for a in zh_starts(plain, road_end(m)))
    for m in _ZH_PLACE.finditer(plain):
        add("address", m)
    for m in _EN_PLACE.finditer(plain) if re.search("[a-z]", plain) else ():
        add("address", m)
    for m in _ZH_CUED.finditer(plain):
        group = m.lastgroup
        a, b = m.span(group)
        for n in range(2, min(4, b - a) + 1) if group == "full" else (b - a, b - a - 1):
            if n >= 2:
                found.add(Span("name", a, a + n))
    for m in _EN_NAME.finditer(plain) if re.search("[a-z]", plain) else ():
        first = m[0].split()[0]
        if first in _NO_FIRST:
            rest = _EN_NAME.match(plain, m.start() + len(first) + 1)
            if rest:
                found.add(Span("name", rest.start(), rest.end()))
        else:
            add("name", m)
    return sorted(found, key=lambda s: (s.start, s.end, s.kind))


def road_end(m: re.Match) -> int:
    """Where the name of the road is over and its kind begins."""
    return m.start() - (m[0][0] in "道同")


@lru_cache(maxsize=256)
def zh_starts(plain: str, road: int) -> tuple[int, ...]:
    """All starts, last first, from which ideographs up to ``road`` read as names of places and one of a road."""
    starts: list[int] = []
    a, known = road - 1, set()
    while a >= 0 and "一" <= plain[a] <= "鿿" and a >= (starts[-1] if starts else road) - PLACE_LENGTH - 1:
        if road - a <= ROAD_LENGTH or any(plain[p] in _PLACE_END and p + 1 in known for p in range(a + 1, min(road - 1, a + PLACE_LENGTH) + 1)):
            starts.append(a)
            known.add(a)
        a -= 1
    return tuple(starts)


@lru_cache(maxsize=256)
def zh_guess(plain: str, road: int) -> tuple[int | None, bool]:
    """The likeliest start, and whether a cue or a short name after a mark makes it sure."""
    starts = zh_starts(plain, road)
    if not starts:
        return None, False
    end = lambda a: next((p for p in range(a + 1, road) if plain[p] in _PLACE_END and p + 1 in starts), road)
    short = lambda a: end(a) - a <= 4 and not _ZH_NOT_NAME.search(plain, a, end(a))
    for a in starts:
        if _ZH_CUE.search(plain, max(0, a - 8), a):
            return a, True
    for a in starts:
        if _ZH_MAYBE.search(plain, max(0, a - 8), a):
            return a, short(a)
    a = starts[-1]
    if not a or not "一" <= plain[a - 1] <= "鿿":
        return a, short(a)
    return max(a, end(a) - 3), False


def _date_like(digits: str) -> bool:
    return len(digits) >= 14 and 1850 <= int(digits[6:10]) <= 2035 and 1 <= int(digits[10:12]) <= 12 and 1 <= int(digits[12:14]) <= 31


def _surname(s: str) -> int:
    return 2 if s[:2] in COMPOUND_SURNAMES else 1 if s[:1] in SINGLE_SURNAMES else 0


#: Place of the phone cue among the features.
CUE_AT = 12


def features(plain: str, s: Span) -> list[float]:
    """Format and context of a span, as numbers."""
    t, left, right = plain[s.start : s.end], plain[max(0, s.start - 16) : s.start], plain[s.end : s.end + 12]
    digits = re.sub(r"\D", "", t)
    before, after = left[-1:], right[:1]
    common = [len(t), len(digits), t.count("-"), t.count(" "), t.count("."), float(t[:1] == "+"), float("(" in t), float(before.isdigit()), float(after.isdigit()), float(before.isascii() and before.isalpha()), float(after.isascii() and after.isalpha()), float(not after or not after.isalnum())]
    cues = [float(bool(c.search(left))) for c in (_PHONE_CUE, _ID_CUE, _ADDRESS_CUE, _MAIL_CUE, _OTHER_CUE)] + [float(bool(_UNIT_AFTER.match(right)))]
    if s.kind == "email":
        own = [float(bool(re.search(_DOT, t))), len(re.findall(_DOT, t)), float("@" in t), float(bool(re.search(r"[A-Za-z]{2,}$", t)))]
    elif s.kind == "phone":
        groups = [len(g) for g in re.findall(r"\d+", t)]
        own = [float(digits[:1] == "1"), float(digits[:1] == "0"), float("转" in t or "ext" in t), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, float(bool(re.match(r"(86)?1[3-9]\d{9}$", digits))), float(_date_like(digits)), float(bool(_GOES_ON.search(left))), float(bool(_FULL_PHONE.fullmatch(t)))]
    elif s.kind == "id_number":
        own = [float(_date_like(digits)), float(t[-1:] in "Xx"), float(t[:1].isalpha()), float(len(digits) in (17, 18)), float(len(digits) > 18)]
    elif s.kind == "address":
        own = [float("号" in t), float(bool(re.search(_EN_ROAD, t))), len(re.findall("[省市县区镇乡]", t)), float(bool(re.search("[室楼层]", t))), float(t[:1].isdigit()), t.count(","), float(bool(re.search(r"[路街巷弄里村道]", t)))]
        house = _ZH_HOUSE.search(plain, s.start, s.end)
        own += [float(house is None or s.start == zh_guess(plain, road_end(house))[0]), float(bool(_ZH_CUE.search(left))), float(bool(_ZH_MAYBE.search(left))), float("一" <= before <= "鿿"), float(before != "" and before in _PLACE_END)]
    else:
        known = _surname(t)
        own = [known, len(t) - known, float(t[:1].isascii()), float(bool(_BEFORE.search(left))), float(bool(_AFTER.match(right))), float(bool(_EN_BEFORE.search(left))), float(bool(_EN_AFTER.match(right))), float(t in ("未录", "阙名", "佚名", "无名")), float(bool(re.search("[某代述口同来自谨携垫付，]", t[1:])))]
        own += [float(known > 0 and own[3] > 0 and own[4] > 0), float(bool(re.match(r"(?:携|谨识|代述|同来|口述|垫付|自述)", right)))]
    return [float(v) for v in (*common, *cues, *own)]


def weak_label(plain: str, s: Span) -> int | None:
    """1 or 0 where a narrow rule is sure, else None."""
    t, left, right = plain[s.start : s.end], plain[max(0, s.start - 16) : s.start], plain[s.end : s.end + 12]
    digits = re.sub(r"\D", "", t)
    if s.kind == "email":
        return int(bool(re.search(_DOT, t)))
    if s.kind == "phone":
        if _OTHER_CUE.search(left) or _UNIT_AFTER.match(right) or _ID_CUE.search(left) or before_letter(left):
            return 0
        if right[:1] == "转" or _GOES_ON.search(left):
            return 0
        if t[:1] != "+" and re.search(r"\+\d{1,3}[ \-]?$", left):
            return 0
        return 1 if _PHONE_CUE.search(left) or _FULL_PHONE.fullmatch(t) else None
    if s.kind == "id_number":
        if _OTHER_CUE.search(left) or _UNIT_AFTER.match(right) or len(digits) > 18:
            return 0
        whole = (len(re.sub(r"[^\dXx]", "", t)) == 18 and _date_like(digits)) or t[:1].isalpha()
        return int(whole) if _ID_CUE.search(left) else None
    if s.kind == "address":
        if t[:1].isdigit() and re.search(_EN_ROAD, t):
            return 1 if not right.startswith(", ") or not right[2:3].isupper() else None
        if house := _ZH_HOUSE.search(plain, s.start, s.end):
            first, sure = zh_guess(plain, road_end(house))
            if s.start != first or not sure:
                return 0 if sure else None
        return int(bool(re.search(rf"{_NUM}(号|室|楼|层)", t)) and not re.match(rf"{_NUM}?(号|单元|室|楼)", right))
    if t[:1].isascii():
        return int(bool(_EN_BEFORE.search(left) or _EN_AFTER.match(right)) and not re.match("-[A-Z]", right))
    known = _surname(t)
    if not known or t in ("未录", "阙名") or re.search("[某代述口自谨携垫付]", t[1:]) or len(t) - known not in (1, 2):
        return 0
    sides = bool(_BEFORE.search(left)), bool(_AFTER.match(right))
    return 1 if all(sides) else 0 if not sides[1] else 1 if re.match(r"[，,]年", right) else None


def before_letter(left: str) -> bool:
    return left[-1:].isascii() and left[-1:].isalpha()


def labelled_spans(texts: list[str]) -> list[tuple[int, str, list[float], int]]:
    """(text, type, features, label) of the spans on which the narrow rules are sure.

    A number that is a phone by its form comes once more without its cue: where every phone of a sample has one, the
    trees would learn nothing else.
    """
    out = []
    for i, text in enumerate(texts):
        plain = flat(text)
        for s in candidates(text, plain):
            if (y := weak_label(plain, s)) is not None:
                row = features(plain, s)
                out.append((i, s.kind, row, y))
                if y and s.kind == "phone" and row[CUE_AT] and _FULL_PHONE.fullmatch(plain, s.start, s.end):
                    out.append((i, s.kind, [*row[:CUE_AT], 0.0, *row[CUE_AT + 1 :]], y))
    return out


def fitted(rows: list[tuple[str, list[float], int, bool]]) -> dict[str, Boosted]:
    """One model a type from spans (type, features, label, held out); held-out ones calibrate it."""
    out = {}
    for kind in TYPES:
        data = [r for r in rows if r[0] == kind]
        x, y, held = np.array([r[1] for r in data], float), np.array([r[2] for r in data], float), np.array([r[3] for r in data], bool)
        out[kind] = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    return out


def train(texts: list[str], seed_step: int = 5) -> dict[str, Boosted]:
    """Models from weakly labelled spans of some texts and of the own sentences; every fifth text is held out for calibration."""
    return fitted([(k, f, y, i % seed_step == 0) for i, k, f, y in labelled_spans(texts)] + [(k, f, y, False) for _, k, f, y in labelled_spans(list(LESSONS))])


#: Own sentences, so that a sample without some type still teaches it.
LESSONS = tuple(
    text
    for k in range(12)
    for text in (
        f"联系电话：1380013{k:04d}。另有编号 142-{1000 + k}。",
        f"电话 (010)6280{k:04d}转{k + 10}，方账第{1000 + k}-{2000 + k}页，银{3000 + k}文。",
        f"Call +1 (555) 555-01{k:02d} before noon. Ledger entry 555-01{k:02d} lists only weights.",
        f"身份证：110101{1950 + k}0704{k:03d}X，已核。藏书号990101198813{k:06d}。",
        f"Identity no. 110101 {1950 + k}0704 {k:04d}. Lot 11010119881345{k:05d} was dried. Document shown: EX53212{k:02d}.",
        f"护照或证件：EX53210{k:02d}。刻本序号第15413{k:02d}叶。",
        f"家住清溪市北岸区长宁路{k + 1}号{k + 2}单元{k + 3}0{k}室。长宁路旧有药肆。",
        f"寄往黑龙江省哈尔滨市道里区人民中路{k + 1}号。上月迁往清河镇东街{k + 5}号，石家庄市旧有药肆。",
        f"服后痛减现寓建国门外大街甲{k + 1}号，药包送至呼和浩特市新城区成吉思汗大街附{k + 2}号之{k + 3}。",
        f"黑龙江省哈尔滨市道里区人民中路{k + 1}号。前门大街{k + 2}号，旧有药肆。病家在清河镇东街{k + 5}号设铺。",
        f"地址：石桥镇东门巷{'一二三四五六七八九十'[k % 10]}十号三楼",
        f"Resident at {k + 11} Mill Hill Road, Eastham. Mill Bend was once a market.",
        f"电邮：wang.lei{k}@mail.example。注家@旁批仅三字。",
        f"Write to li_na{k} (at) mail[dot]example for the list. The scribe wrote @ in the margin.",
        "患者姓名 王亦秋；（记录人：欧阳令）其母李芸代述。病家某自述如前。患者姓名 未录；",
        "抄者赵听之谨识。是日孙若舟携幼子来诊。（记录人：阙名）药费由周怀蓁垫付。",
        "Patient: Anna Fairfield. As Peter Stone recalled, it eased. The note was signed by Mary Lowell.",
    )
)


class Finder:
    """Models and cutoffs of all types, ready to be broadcast."""

    def __init__(self, models: dict[str, Boosted]) -> None:
        self.models = models

    def spans(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        """Selected spans of each text: the most probable of those that overlap, then the longest."""
        plains = [flat(t) for t in texts]
        every = [(i, s) for i, (t, p) in enumerate(zip(texts, plains, strict=True)) for s in candidates(t, p)]
        prob = np.zeros(len(every))
        for kind, model in self.models.items():
            at = [k for k, (_, s) in enumerate(every) if s.kind == kind]
            if at:
                prob[at] = model.predict(np.array([features(plains[every[k][0]], every[k][1]) for k in at]))
        out: list[list[tuple[Span, float]]] = [[] for _ in texts]
        chosen = [(-round(float(p), 3), s.start - s.end, i, s, float(p)) for (i, s), p in zip(every, prob, strict=True) if p >= self.models[s.kind].cutoff]
        for *_, i, s, p in sorted(chosen, key=lambda c: (*c[:3], c[3].start)):
            if all(s.end <= x.start or s.start >= x.end for x, _ in out[i]):
                out[i].append((s, p))
        return [sorted(x, key=lambda y: y[0].start) for x in out]


def trained_finder(docs: DataFrame, *, key: str = "doc_id", text: str = "text", train_rows: int = 3000) -> Finder:
    """A finder trained on at most ``train_rows`` whole documents, the first in the order of a hash of the key.

    Hashes above a cutoff, which leaves half as many rows again as are wanted, are dropped at the scan, so that what
    reaches the driver doesn't grow with the number of tasks: hashes first, then labelled spans, never texts.
    """
    total = docs.count()
    low = -(2**63) + int(2**64 * min(1.0, 1.5 * train_rows / max(1, total)))
    hashed = docs.select(key, text, F.xxhash64(key).alias("_h")).filter(F.col("_h") <= F.lit(min(low, 2**63 - 1)))
    last = hashed.select("_h").orderBy("_h").limit(train_rows).agg(F.max("_h")).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = (b["_h"] % 5 == 0).tolist()
            rows = [(k, f, y, held[i]) for i, k, f, y in labelled_spans([t or "" for t in b[text]])]
            yield pd.DataFrame(rows, columns=["kind", "features", "label", "held"])

    rows: list = []
    if last is not None:
        rows = [tuple(r) for r in hashed.filter(F.col("_h") <= last).mapInPandas(run, "kind string, features array<double>, label int, held boolean").collect()]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))  # the order of tasks doesn't matter
    return Finder(fitted(rows + [(k, f, y, False) for _, k, f, y in labelled_spans(list(LESSONS))]))


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text", finder: Finder | None = None, **bounds: int) -> DataFrame:
    """(key, pii_type, start_at, end_at, found_text, probability) of every mention in every text.

    Null and empty texts give no row; repeated rows give theirs again; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(finder or trained_finder(docs, key=key, text=text, **bounds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b[key].tolist(), [t or "" for t in b[text]]
            rows: list[tuple] = []
            for a in range(0, len(ids), 500):
                part = texts[a : a + 500]
                rows += [(i, s.kind, s.start, s.end, t[s.start : s.end], p) for i, t, found in zip(ids[a : a + 500], part, shared.value.spans(part), strict=True) for s, p in found]
            yield pd.DataFrame(rows, columns=[key, "pii_type", "start_at", "end_at", "found_text", "probability"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, pii_type string, start_at int, end_at int, found_text string, probability double")


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", finder: Finder | None = None, **bounds: int) -> DataFrame:
    """(key, redacted, n_found): whole texts with typed placeholders; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(finder or trained_finder(docs, key=key, text=text, **bounds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, rows = b[text].tolist(), []
            for t, found in zip(texts, shared.value.spans([t or "" for t in texts]), strict=True):
                done = t
                for s, _ in reversed(found):
                    done = done[: s.start] + PLACEHOLDERS[s.kind] + done[s.end :]
                rows.append((done, len(found)))
            yield pd.DataFrame({key: b[key], "redacted": [r[0] for r in rows], "n_found": [r[1] for r in rows]})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, redacted string, n_found int")
