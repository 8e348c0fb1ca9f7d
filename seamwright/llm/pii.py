"""Personal data in free text: e-mail addresses, phone and identity numbers, street addresses, names.

Weak supervision.  Wide patterns propose candidate spans of each kind.  Labelers (formats,
gazetteers, checks of digits, contexts on either side, look-alikes) vote for, against or
not at all.  Expectation-maximisation over the counts of all vote patterns of the whole
corpus estimates how reliable each labeler is, and from the resulting soft labels a
logistic span classifier is trained on all patterns.  The classifier decides; overlapping
spans are resolved by its probability, then by length.

Candidates and their votes are found once and kept as a table; the fit counts its patterns
and the classifier runs over it.  Only pattern counts reach the driver: a row per distinct
combination of votes, bounded by the labelers, not by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .texts import map_texts

#: kinds of candidates; Chinese names have labelers of their own and come out as names
KINDS = ("email", "phone", "id_number", "address", "name", "name_zh")
#: vote patterns beyond this many mean that a labeler is not discrete; fitting then refuses
MAX_PATTERNS = 20_000


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]


@lru_cache(maxsize=8)
def _surnames_zh(listed: frozenset) -> re.Pattern:
    longer = {*(f for f in listed if len(f) > 1), *_COMPOUND}
    return re.compile(f"(?=({'|'.join(sorted(longer))})?)[{''.join(sorted(_SURNAMES | {f[0] for f in listed | longer}))}]")


class Gazetteer(NamedTuple):
    """Known parts of names; also their endings, as parts are formed alike."""

    given: frozenset
    family: frozenset
    given_zh: frozenset
    family_zh: frozenset
    endings: frozenset

    @property
    def start_zh(self) -> re.Pattern:
        """Where a Chinese name can begin: at a surname, listed or common, of one character or two; overlaps count."""
        return _surnames_zh(self.family_zh)

    @staticmethod
    def of(rows) -> Gazetteer:
        """From (token, kind, lang) rows; nulls are left out."""
        rows = [(t.strip(), k, ln) for t, k, ln in rows if t and t.strip() and k]
        zh = lambda t: re.search(r"[一-鿿]", t) is not None
        latin = [t.lower() for t, _, _ in rows if not zh(t)]
        count: dict[str, int] = {}
        for t in latin:
            for n in (3, 4, 5):
                if len(t) > n + 1:
                    count[t[-n:]] = count.get(t[-n:], 0) + 1
        return Gazetteer(
            frozenset(t.lower() for t, k, _ in rows if k == "given" and not zh(t)),
            frozenset(t.lower() for t, k, _ in rows if k == "family" and not zh(t)),
            frozenset(t for t, k, _ in rows if k == "given" and zh(t)),
            frozenset(t for t, k, _ in rows if k == "family" and zh(t)),
            frozenset(e for e, n in count.items() if n >= 3),
        )


# Words that begin sentences or name things, titles, street words, surnames.
_COMMON = frozenset(
    "the a an on in at by to of for from and or but if when while after before as it its this that these those we you he she they i my our your his her their what which who why how where there here not no yes "
    "please run add ask see install chapter section ticket lesson step steps still one return keep compare split merge load sort link project count "
    "according thanks regards dear hi hello note notes monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "number contact phone tel passport ssn id file author reviewed signed someone quoted my answer view table release build zone street bay apt unit suite room floor north south east west new old".split()
)
_TITLES = frozenset("dr mr mrs ms miss prof professor sir madam rev hon".split())
_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|way|drive|dr|court|ct|place|pl|boulevard|blvd|terrace|close|crescent|row|square|sq|parkway|pkwy|walk|quay|mews|hill|gardens|circle|trail|alley|path|highway|hwy)"
_SURNAMES = frozenset(
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐庞伍褚卫尤乔蓝俞柳鲍倪翁"
)

_COMPOUND = ("欧阳", "上官", "司马", "司徒", "诸葛", "东方", "皇甫", "尉迟", "慕容", "令狐", "夏侯", "长孙", "宇文", "轩辕", "端木", "南宫", "独孤", "公孙", "百里", "呼延")
#: words that begin with a surname; characters that are grammar rather than part of a name
_WORDS_ZH = frozenset(
    "向量 向上 向下 向前 向后 范围 范例 方法 方案 方式 方便 方向 方面 于是 金额 任务 任何 任意 何时 何处 何种 白天 白色 石桥 石头 马上 温度 温和 程序 程度 文件 文档 文本 文字 文章 施加 施工 安全 安装 安排 段落 严格 严重 尤其 万一 "
    "庞大 齐全 谢谢 史料 周期 周围 周末 时候 高效 高级 高度 余下 余的 陈述 陈旧 孔径 蓝色 常用 易于 单元 成功 毛病 钟头 钱包 汤匙 黄色 黄金 许多 许可 郑重 顾客 顾及 武器 康复 戴上 倪端 龙头 雷达 江河 孙子 于此 路径 路由 邮箱 曾经 田间 董事 叶子 程中 鲍鱼 牛奶 柳树".split()
)
_GRAMMAR_ZH = frozenset("的了是在和与或把被对从这那其每没吗呢吧么们着过个些只还跟给让请说")
_HAN = re.compile(r"[一-鿿]+")
_LABEL_ZH = re.compile(r"(?:感谢|多谢|[收寄发]件人|负责人|联系人?|作者|姓名|名字|维护者|审[核阅]人?|评审人?|抄送|我叫|我是|昨天和|客户|学员|@)(?:是|为)?[：:\s]*$")
_WITH_ZH = re.compile(r"[请由找给问和与跟同]$")
_AFTER_ZH = re.compile(
    r"(?:提交|老师|同学|先生|女士|教授|博士|主任|经理|写道|说[：:，]|负责(?!人)|指出|问道|提出|讨论|打电话|发邮件|来电|来信|回复|反馈|确认|建议|认为|表示|[\s（(<，,、|：:]*(?:的)?(?:电话|手机|邮箱|邮件|地址|住址|微信|身份证|证件|联系|号码|(?i:tel|phone|e-?mail))|[\s（(<，,、|]+(?:[\w.+-]+\s?[@＠]|[+（(]*\d{3}))"
)

_EMAIL = re.compile(
    r"(?<![A-Za-z0-9_.+-])(?P<local>[A-Za-z0-9][A-Za-z0-9_.+-]*?)(?P<at>\s?[@＠]\s?|\s*[\[({<]\s*(?:at|AT)\s*[\])}>]\s*|\s+(?:AT)\s+)(?P<domain>[A-Za-z0-9-]+(?:(?:[.．]|\s[.．]\s|\s*[\[({]\s*(?:dot|DOT)\s*[\])}]\s*)[A-Za-z0-9-]+)+)"
)
_PHONE = re.compile(r"(?<![A-Za-z0-9_.#/+-])(?:\+|00)?[(（]?\d{1,5}[)）]?(?:[ .\-]?[(（]?\d{2,5}[)）]?){1,5}(?:\d{1,8})?(?:\s*(?:ext\.?|extension|x|转|分机)\s*\d{1,6})?(?![A-Za-z0-9_])")
_ID = re.compile(
    r"(?<![A-Za-z0-9_.-])(?:\d{17}[\dXx]|\d{15}|\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|[A-Z]{1,2}\d{7,9}|[A-Z]\d{2}[ -]?\d{3}[ -]?\d{3})(?![A-Za-z0-9_-])"
)
_ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]?\s+(?:[A-Z][\w'’-]*\s+){{1,3}}(?i:{_STREET})\b\.?(?P<more>(?:\s*[,\n]\s*(?:Apt|Apartment|Suite|Unit|Flat|Floor|#)\.?\s*[\w-]+)?(?:\s*[,\n]\s*[A-Z][\w'-]+(?:\s[A-Z][\w'-]+)?)?(?:,?\s*[A-Z]{{2}})?(?:\s+\d{{5}}(?:-\d{{4}})?)?)"
    r"|(?<![\w-])[A-ZÄÖÜ][\w'-]+(?:[ -][A-Z][\w'-]+)?\s+\d{1,4}[a-z]?,\s*(?P<zip>\d{4,5})\s+[A-ZÄÖÜ][\w-]+(?:\s[A-Z][\w-]+)?"
)
_ADDRESS_ZH = re.compile(r"(?P<street>[一-鿿]{1,6}?(?:大道|大街|胡同|路|街|巷|弄))(?P<no>[\d０-９]+(?:弄[\d０-９]+)?号)(?P<more>(?:[\d０-９]+(?:号楼|栋|幢|座|单元|层|室))*)")
_ZH_BREAK = "到在至于是为从往寄住址：:，。、；（( 去回搬家给达"
_WORD = r"(?:[A-Z][a-z’']+(?:[A-Z][a-z]+)?|[A-Z]{2,})"
_NAME = re.compile(
    rf"(?<![\w@/.’'-])(?=((?:{_WORD})(?:-{_WORD})?(?:\s(?:[A-Z]\.\s?)+|\s)(?:{_WORD})(?:-{_WORD})?|(?:[A-Z]\.\s?){{1,3}}(?:{_WORD})(?:-{_WORD})?|(?:{_WORD})(?:-{_WORD})?,\s(?:{_WORD}|[A-Z]\.)(?:\s[A-Z]\.)?)(?![\w@/]|-[A-Za-z]))"
)
_NAME_ZH = re.compile(r"(?=([一-鿿]{2,3}))")

_BEFORE_NAME = re.compile(
    r"(?:\bping|\bcc:?|\bby:|\bby|-by:|author\s*=\s*[\"'`]|author:?|\bam|\bI'm|\buser[\"']?:\s*[\"']|\bname[\"']?\s*[:=]\s*[\"']?|\baccording to|\bis|\bfrom|\bwith|contact:?|[—–]|\b(?:Dr|Mr|Mrs|Ms|Prof)\.?|thanks to|\bHi|\bDear|\bHello|\bday|\||to:|\bcontact|\bvia|\basked)\s*$",
    re.I,
)
_AFTER_NAME = re.compile(
    r"^\s*(?:asked|wrote|writes|said|says|thinks|agreed|offered|promised|decided|wants|and I\b|,? who\b|<|\(?[\w.+-]+\s?[@＠]|at [\w.+-]+\s?[@＠\[(]|[,|]\s*(?:[\w.+-]+\s?(?:[@＠]|\[at\])|\+?[(（]?\d)|, backup|reported|filed|mentioned|replied|confirmed|suggested|signed|here\b|[\"']\s*,\s*[\"'](?:tel|email|phone))",
    re.I,
)
_THING_AFTER = re.compile(r"^\s*(?:release|build|zone|view|table|module|server|cluster|project|library|package|branch|tool|plugin|team|office|station|street|lane|way|road|avenue|bay|(?:[\w-]+\s+)?\d{1,4}[a-z]?,\s*\d{4,5}\b)", re.I)
_CONTACT = re.compile(r"(?:call|phone|tel|telephone|mobile|cell|number is|reach me|reach|contact|text me|fax|whatsapp|手机|电话|联系|拨打|号码)[^\n]{0,28}$", re.I)
_IDENTITY = re.compile(r"(?:\bssn\b|\bid\b|passport|national id|identity|tax|insurance|licen[cs]e no|身份证|证件|护照|社保)[^\n]{0,24}$", re.I)
_COUNTED = re.compile(r"(?:\brun|\bticket|\bbytes|\bport|\bline|\blines|\bversion|\bv|\bbuild|\bissue|\bpr|\bcommit|\bschema|\bsection|\bchapter|\border|\bshard|\bsnapshot|\blimit|#|\brev(?:ision)?|\bat|took|finished after)\s*[#:=]?\s*$", re.I)
_LIVING = re.compile(r"(?:address|live|lives|living|moved|place is|drop by|visit|ship|send|mail|deliver|invoice|located|home|office is|come to|寄|住|地址|送|搬|收件)[^\n]{0,40}$", re.I)
_URLISH = re.compile(r"(?:https?://|git@|ssh://|www\.)\S*$")


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


_PHONE_FORMATS = re.compile(
    r"(?:(?:\+?1[ .-]?)?(?:[(（]\d{3}[)）][ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}|\+1\d{10}|(?:\+44[ ]?7\d{3}|07\d{3})[ ]?\d{3}[ ]?\d{3}|\+\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ .-]?)\d{2,5}(?:[ .-]?\d{2,5}){0,3}"
    r"|(?:\+?86[ -]?)?1\d{2}[ -]?\d{4}[ -]?\d{4}|[(（]0\d{2,3}[)）][ -]?\d{7,8}|0\d{2,3}-\d{7,8})(?:\s*(?:ext\.?|extension|x|转|分机)\s*\d{1,6})?"
)


def candidates(text: str, gaz: Gazetteer) -> list[Span]:
    """All candidate spans of a text with the votes on them."""
    out: list[Span] = []
    emails: list[tuple[int, int]] = []
    low = text.lower()
    if "@" in text or "＠" in text or "[at" in low or "(at" in low or " AT " in text or "{at" in low:
        for m in _EMAIL.finditer(text):
            start, end = m.start(), m.end()
            before, after = text[max(0, start - 40) : start], text[end : end + 20]
            tld = re.split(r"[\s.．\])}]+", m["domain"].strip())[-1]
            local = m["local"].lower()
            emails.append((start, end))
            out.append(
                Span("email", start, end, (
                    _vote(tld.isalpha() and 2 <= len(tld) <= 12, True),
                    _vote(local not in ("git", "svn", "hg", "root") and not re.match(r":[\w./~-]", after), True),
                    _vote(re.search(r"(?:mailto:|<|write to|ping|contact|reach|e-?mail|抄送|发到|联系|at|or|to|\||/)\s*$", before, re.I) is not None, _URLISH.search(before) is not None),
                    _vote(len(local) > 1 and "." not in (local[0], local[-1]), True),
                )))
    if re.search(r"\d{2}", text):
        for m in _PHONE.finditer(text):
            s, start = m[0].rstrip(), m.start()
            if s.count("(") + s.count("（") < s.count(")") + s.count("）"):
                s = s.rstrip(")）")
            if s[:1] in "(（" and (not re.search(r"[)）]", s) or re.fullmatch(r"[(（][^()（）]*[)）]", s)):
                s, start = s[1:].rstrip(")）"), start + 1
            digits = _digits(re.sub(r"(?:ext\.?|extension|x|转|分机).*", "", s))
            if not 7 <= len(digits) <= 15:
                continue
            end = start + len(s)
            before, after = text[max(0, start - 40) : start], text[end : end + 12]
            ip = re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s) is not None
            date = re.fullmatch(r"(?:19|20)\d\d[-. ]\d{1,2}[-. ]\d{1,2}", s) is not None
            ssn = re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", s) is not None
            near = any(abs(a - end) < 12 or abs(start - b) < 12 for a, b in emails)
            out.append(
                Span("phone", start, end, (
                    _vote(_PHONE_FORMATS.fullmatch(s) is not None, True),
                    _vote(s[0] in "+(（" and len(digits) >= 9, ip or date or ssn),
                    _vote(_CONTACT.search(before) is not None or near or re.search(r"(?:tel|phone)[\"']?\s*:\s*[\"']?$", before) is not None, _COUNTED.search(before) is not None or _IDENTITY.search(before) is not None),
                    _vote(10 <= len(digits) <= 13, len(digits) < 9),
                    _vote(re.search(r"[—–|/]\s*$|,\s*$", before) is not None, re.match(r"\s*(?:ms|rows|bytes|workers|lines|s\b|%|of the)", after) is not None),
                )))
        for m in _ID.finditer(text):
            s, start, end = m[0], m.start(), m.end()
            before = text[max(0, start - 40) : start]
            zh = re.fullmatch(r"\d{17}[\dXx]", s) is not None
            born = zh and 1900 <= int(s[6:10]) <= 2030 and 1 <= int(s[10:12]) <= 12 and 1 <= int(s[12:14]) <= 31
            born = born and not _COUNTED.search(before)  # a number of something else may hold a date
            ssn = re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}", s) is not None
            ni = re.fullmatch(r"[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]", s) is not None
            out.append(
                Span("id_number", start, end, (
                    _vote(born or ssn or ni or re.fullmatch(r"[A-Z]\d{8}", s) is not None, zh or s.isdigit()),
                    _vote(_IDENTITY.search(before) is not None, _COUNTED.search(before) is not None),
                    _vote(born or ni, zh and not born),
                    _vote(False, _CONTACT.search(before) is not None and not _IDENTITY.search(before)),
                )))
        for m in _ADDRESS.finditer(text):
            start, end = m.start(), m.end()
            before, after = text[max(0, start - 60) : start].replace("\n", " "), text[end : end + 30]
            out.append(
                Span("address", start, end, (
                    1,
                    _vote(_LIVING.search(before) is not None, _COUNTED.search(before) is not None),
                    _vote(re.search(r"\d{5}|Apt|Suite|Unit|Flat", m["more"] or "") is not None or m["zip"] is not None),
                    _vote(False, re.match(r"\s*(?:rows|ms|of the|build|release|zone|files)", after) is not None),
                )))
        if "号" in text:
            for m in _ADDRESS_ZH.finditer(text):
                start, end = m.start("street"), m.end()
                street = m["street"]
                cut = max((street.rfind(c) for c in _ZH_BREAK), default=-1)
                start += cut + 1
                # the streets of a city follow its name, districts between
                back = text[max(0, start - 14) : start]
                city = re.search(r"((?:[一-鿿]{2,6}?(?:省|自治区))?(?:[一-鿿]{2,5}?(?:市|州|县))?(?:[一-鿿]{1,4}?(?:区|县|镇|乡|村))?)$", back)
                inner = re.match(r"((?:[一-鿿]{2,4}?市)?(?:[一-鿿]{1,3}?区)?)", text[start : m.end("street")])
                if city and city[1]:
                    a = start - len(city[1])
                    head = text[a:start]
                    cut = max((head.rfind(c) for c in _ZH_BREAK), default=-1)
                    start = a + cut + 1
                before = text[max(0, start - 20) : start]
                out.append(
                    Span("address", start, end, (
                        1,
                        _vote(_LIVING.search(before) is not None),
                        _vote("市" in text[start:end] or bool(m["more"]) or inner is not None and bool(inner[1])),
                        _vote(False, re.search(r"(?:第|编|证件|课|版)[^，。]{0,3}$", before) is not None),
                    )))
    out.extend(_names(text, gaz, emails))
    return out


def _names(text: str, gaz: Gazetteer, emails: list[tuple[int, int]]) -> list[Span]:
    out: list[Span] = []
    for m in _NAME.finditer(text):
        s, start, end = m[1], m.start(), m.end(1)
        words = re.findall(r"[A-Za-z’']+", s.replace("-", " "))
        real = [w.lower() for w in words if len(w) > 1]
        comma = "," in s
        if not real or real[0] in _TITLES or (len(real) == 1 and not re.match(r"[A-Z]\.", s) and not comma):
            continue
        if s.isupper() and len(real) > 1 and max(map(len, real)) < 4:
            continue
        before, after = text[max(0, start - 24) : start], text[end : end + 60]
        first, last = (real[-1], real[0]) if comma else (real[0], real[-1])
        if len(real) == 1:
            first, last = "", real[0]
        known_first = first in gaz.given
        known_last = last in gaz.family or any(w in gaz.family for w in real[1:])
        alike = lambda w: any(w[-n:] in gaz.endings for n in (3, 4, 5) if len(w) > n + 1)
        common = any(w in _COMMON for w in real)
        near = any(0 <= a - end < 8 for a, _ in emails)
        initial = re.search(r"(?:^|\s)[A-Z]\.", s) is not None
        loud = s.isupper() and re.search(r"[A-Z]{2,}\s$", before) is not None and re.match(r"\s[A-Z]{2,}", after) is not None
        out.append(
            Span("name", start, end, (
                _vote(known_first or (not first and initial), first in gaz.family and last in gaz.given),
                _vote(known_last, last in gaz.given and not comma),
                _vote((not first or alike(first)) and alike(last), not alike(last) and not known_last),
                _vote(_BEFORE_NAME.search(before) is not None, re.search(r"\b(?:the|a|an|each|every|in the)\s*$", before, re.I) is not None),
                _vote(_AFTER_NAME.match(after) is not None or near, _THING_AFTER.match(after) is not None),
                _vote(initial or comma and known_first and known_last, common),
                _vote(False, comma and re.search(r"[a-z]\s$", before) is not None and re.search(r"[A-Z][\w-]+\s$", before) is not None or re.search(r"\d\s*$|[\d,]\s+$|\b(?:street|lane|way|road|st\.?|apt \w+),?\s*$", before, re.I) is not None and not known_first),
                _vote(False, loud or any(w in _COMMON for w in real) or re.search(r"\b[A-Z]\.?$", before) is not None),
            )))
    out.extend(_names_zh(text, gaz))
    return out


def _names_zh(text: str, gaz: Gazetteer) -> list[Span]:
    """Every surname with one or two characters after it; what stands around it votes, the list of given parts only does so too."""
    out: list[Span] = []
    for m in gaz.start_zh.finditer(text):
        start = m.start()
        before = text[max(0, start - 8) : start]
        label, word = _LABEL_ZH.search(before) is not None, _WITH_ZH.search(before) is not None
        inner = re.search(r"[一-鿿]\Z", before) is not None
        for family in dict.fromkeys((m[1] or m[0], m[0])):
            if len(family) == 1 and family not in gaz.family_zh and family not in _SURNAMES:
                continue
            both = []
            for n in (len(family) + 2, len(family) + 1):
                s = text[start : start + n]
                if len(s) == n and _HAN.fullmatch(s):
                    after = text[start + n : start + n + 24]
                    both.append((n, s[len(family) :], _AFTER_ZH.match(after) is not None, _HAN.match(after) is not None))
            for n, given, right, more in both:
                known = given in gaz.given_zh
                if not (known or right) and any(r or g in gaz.given_zh for _, g, r, _ in both):
                    continue  # the same surname with one character more or less is the name
                out.append(
                    Span("name_zh", start, start + n, (
                        _vote(family in gaz.family_zh or len(family) > 1),
                        _vote(known),
                        _vote(label, inner and not (label or word or known)),
                        _vote(word and not label),
                        _vote(right, more and not known),
                        _vote(False, any(c in _GRAMMAR_ZH for c in given)),
                        _vote(not inner and not more),
                        _vote(False, text[start : start + 2] in _WORDS_ZH),
                    )))
    return out


# ---------------------------------------------------------------------------- label model and classifier
def _design(votes: np.ndarray) -> np.ndarray:
    """Features of vote patterns: for, against, and how many of each."""
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    return np.hstack([np.ones((len(votes), 1)), yes, no, yes.sum(1, keepdims=True) / 2, no.sum(1, keepdims=True) / 2])


def fit_kind(votes: np.ndarray, counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of the span classifier of one kind from its vote patterns and their counts.

    EM of a two-class model with independent labelers and three outcomes each; it starts
    from the balance of votes, which also gives the pseudo-counts that keep the classes in
    their roles.  The classifier is fitted to the soft labels by damped Newton steps.
    """
    n = counts.sum()
    balance = (votes > 0).sum(1) - 1.5 * (votes < 0).sum(1)
    start = 1 / (1 + np.exp(-(1.5 * balance - 1.5)))
    p = start.copy()
    prior = np.clip((p * counts).sum() / n, 0.02, 0.98)
    outcomes = (-1, 0, 1)
    pseudo = max(5.0, 0.3 * n)
    base = np.zeros((2, votes.shape[1], 3))
    for y, w in ((1, start * counts), (0, (1 - start) * counts)):
        for j, v in enumerate(outcomes):
            base[y, :, j] = ((votes == v) * w[:, None]).sum(0) + 0.5
    base /= base.sum(2, keepdims=True)
    for _ in range(rounds):
        cond = np.zeros_like(base)
        for y, w in ((1, p * counts), (0, (1 - p) * counts)):
            for j, v in enumerate(outcomes):
                cond[y, :, j] = ((votes == v) * w[:, None]).sum(0)
        cond += pseudo * base
        cond /= cond.sum(2, keepdims=True)
        log = np.log(np.array([1 - prior, prior]))[:, None] + np.array(
            [sum(np.log(cond[y, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for y in (0, 1)]
        )
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        prior = np.clip((p * counts).sum() / n, 0.02, 0.98)
    x = _design(votes)
    w = np.zeros(x.shape[1])
    weight = counts / n
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - p)) + 1e-4 * w
        hess = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(votes, weights: np.ndarray) -> float:
    z = float(_design(np.asarray([votes]))[0] @ weights)
    return 1 / (1 + np.exp(-z)) if z > -30 else 0.0


class Model(NamedTuple):
    """The gazetteer and the classifier weights of each kind."""

    gaz: Gazetteer
    weights: dict[str, np.ndarray]


def gazetteer(names: DataFrame) -> Gazetteer:
    """The list of name parts (token, kind, lang), which is short and known to be incomplete.

    It is collected; at most 100 000 rows of it are accepted.
    """
    rows = names.select("token", "kind", "lang").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of name parts is too long to be sent to every task")
    return Gazetteer.of([tuple(r) for r in rows])


_SIGNS = {-1: "-", 0: "0", 1: "+"}
_VOTES = {v: k for k, v in _SIGNS.items()}


def _packed(found: list[Span]) -> str:
    return "\n".join(f"{s.kind} {s.start} {s.end} {''.join(map(_SIGNS.__getitem__, s.votes))}" for s in found)


def _unpacked(packed: str) -> list[Span]:
    out = []
    for line in packed.split("\n") if packed else ():
        kind, start, end, votes = line.split(" ")
        out.append(Span(kind, int(start), int(end), tuple(map(_VOTES.__getitem__, votes))))
    return out


def candidate_spans(documents: DataFrame, gaz: Gazetteer, with_text: bool = False) -> DataFrame:
    """(doc_id, text, spans): the candidates of every document with their votes, written once; null texts are left out.

    ``text`` is null unless ``with_text``.
    """
    rows = lambda t, _: [(t if with_text else None, _packed(candidates(t, gaz)))]
    tag = f"pii-{with_text}-{hash(gaz) & 0xFFFFFFFF:x}"
    df = documents.select("doc_id", "text", F.lit("").alias("arg"))
    return written(map_texts(df, ["doc_id"], "text", "arg", rows, "doc_id long, text string, spans string", tag))


def fit(spans: DataFrame, gaz: Gazetteer) -> Model:
    """The span classifier, fitted on the vote patterns of all candidates (see ``candidate_spans``)."""
    each = spans.where("spans != ''").select(F.explode(F.split("spans", "\n")).alias("s")).select(F.split("s", " ").alias("s"))
    counted = each.groupBy(F.col("s")[0].alias("kind"), F.col("s")[3].alias("votes")).count().limit(MAX_PATTERNS + 1).collect()
    if len(counted) > MAX_PATTERNS:
        raise ValueError("too many vote patterns")
    weights = {}
    for kind in KINDS:
        mine = sorted((r["votes"], r["count"]) for r in counted if r["kind"] == kind)
        if mine:
            v = np.array([[_VOTES[x] for x in p] for p, _ in mine])
            weights[kind] = fit_kind(v, np.array([float(c) for _, c in mine]))
    return Model(gaz, weights)


def spans(text: str, model: Model, memo: dict | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, in order, without overlaps."""
    return chosen(candidates(text, model.gaz), model, {} if memo is None else memo)


def chosen(found: list[Span], model: Model, memo: dict) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the candidates the classifier takes, in order, without overlaps."""
    scored = []
    for s in found:
        key = (s.kind, s.votes)
        p = memo.get(key)
        if p is None:
            p = memo[key] = probability(s.votes, model.weights[s.kind]) if s.kind in model.weights else 0.0
        if p >= 0.5:
            scored.append((p, s))
    # a name is not cut short: the longer candidate stands unless it takes in a common word
    whole = [s for _, s in scored if s.kind in ("name", "name_zh") and s.votes[7] == 0]
    scored = [
        (p, s) for p, s in scored
        if s.kind not in ("name", "name_zh") or not any(t.start <= s.start and s.end <= t.end and t.end - t.start > s.end - s.start for t in whole)
    ]
    scored.sort(key=lambda x: (-round(x[0], 3), -(x[1].end - x[1].start), x[1].start))
    taken: list[Span] = []
    for _, s in scored:
        if all(s.end <= t.start or s.start >= t.end for t in taken):
            taken.append(s)
    return sorted(((s.kind.removesuffix("_zh"), s.start, s.end) for s in taken), key=lambda x: x[1])


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with a placeholder like ``[EMAIL]`` for each span."""
    out, at = [], 0
    for kind, a, b in found:
        out.append(text[at:a] + f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def personal_data(documents: DataFrame, names: DataFrame | None = None, with_text: bool = False, model: Model | None = None) -> DataFrame:
    """(doc_id, kind, start_char, end_char), or with ``with_text`` (doc_id, n_spans, text) masked.

    Null texts give no rows; a repeated document gives its rows again.  ``names`` see
    ``gazetteer``; the classifier is fitted on these documents unless a ``model`` is given.
    """
    gaz = model.gaz if model else gazetteer(names)
    table = candidate_spans(documents, gaz, with_text)
    model = model or fit(table, gaz)
    schema = "doc_id long, n_spans int, text string" if with_text else "doc_id long, kind string, start_char long, end_char long"
    names_of = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema([(n, pa.string() if n in ("kind", "text") else pa.int32() if n == "n_spans" else pa.int64()) for n in names_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, packed in zip(*(c.to_pylist() for c in batch.columns)):
                found = chosen(_unpacked(packed), model, memo)
                rows.extend([(doc, len(found), masked(text, found))] if with_text else [(doc, *f) for f in found])
            columns = zip(*rows) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return table.mapInArrow(run, schema)
