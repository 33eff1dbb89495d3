"""Problem 8: template residue, filler, error pages and demands for scripts.

Rules give trusted labels: an unfilled template field anywhere in a text, or a text that has nothing but residue and
page furniture. Labels of whole-text residue then spread through the connected components of near-duplicates. The texts
are compared without markup and furniture, by the five-word shingles of what is left: a SimHash of many bits is cut into
tables, so many that a pair at the least similarity shares a key with FOUND probability at any number of texts; pairs
that share a key are verified by Hamming distance, then by their shingles; a round is repeated with what it labelled until
nothing is new. SimHashes are made only of texts that share one of their least shingles with a text of the other side, as all
similar texts do. Equal texts are one vertex throughout.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.runtime import drop_stage, lookup_join, spread, stage, table

SIMILARITY, SHINGLE = 0.8, 5
#: The share of pairs at SIMILARITY that the tables find (more similar ones are found more often).
FOUND = 0.97
#: The share of bits in which the SimHashes of two texts at SIMILARITY agree: the angle between sets of equal size.
BIT_AGREES = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Pairs whose SimHashes differ in more bits than SPARE standard deviations over what is expected are not compared by text.
SPARE = 5
#: Similar texts are in the same or in neighbouring bands of sizes; above 1 / SIMILARITY, so rounding cannot part them.
BAND = 1.3
#: Labelled texts of one bucket that meet its unlabelled texts in one step; the others meet in the next steps what is still unlabelled.
SLICE = 64
#: Bits of the filter of shingles as a power of two (16 MB), the bits that a shingle sets, and up to how many texts go to all executors.
FILTER, TRIES, FEW_IDS = 27, 4, 500_000

_NAME = r"[A-Za-z_][\w.\-]*+(?:\[\d+\])?+(?:\.\w+)*+"
# The spellings of template fields, one per template language.
FIELD_PATTERNS = [
    r"\{\{\{?\s*" + _NAME + r"[^{}\n]*+\}\}",  # {{ name }}, {{{name|}}}
    r"\{%-?\s*\w++[^%\n]*+%\}",  # {% block name %}
    r"<%[=\-]?\s*" + _NAME + r"[^%\n]*+%>",  # <%= name %>
    r"[$#@]\{\s*" + _NAME + r"[^{}\n]*+\}",  # ${name}, #{name}
    r"\$\(\s*" + _NAME + r"\s*\)",  # $(name)
    r"(?<![\w$])\$[A-Z][A-Z_]{2,}\$?(?!\w)",  # $NAME$
    r"%\(" + _NAME + r"\)[sdfr]",  # %(name)s
    r"%%[A-Za-z_]+%%",
    r"(?<!%)%[A-Z][A-Z_]{2,}%",
    r"@@[A-Za-z_]+@@",
    r"__[A-Z][A-Z_]*[A-Z]__",
    r"\[\[\[[^\[\]\n]++\]\]\]",
    r"\[\[\s*[a-z]+(?:[_.][a-z]+)*\s*\]\]",
    r"[«‹][A-Z]{2,}(?:_[A-Z]+)*[»›]",
    r"(?<![\w{])\{\s*(?:[a-z]+(?:[_.][a-z]+)*|\d)\s*\}(?![\w}])(?!\s*[,:]\s*\{)|\{[a-z]+_[a-z_]+\}|\{\d\}",  # {name}, {3}
    r"<!--\s*[\w.\[\]\- ]+?(?:goes here|here|placeholder)\s*-->",
    r"&lt;\s*[A-Za-z]\w*(?:[_ .]\w+)*\s*&gt;",
    r"\[(?:insert|enter|add|type|put|fill in|write)\b[^\[\]\n]*+\]",
    r"\[(?:your|our|the) [a-z][^\[\]\n]*+\]",
    r"\[[A-Za-z]+(?:_[A-Za-z]+)+\]",
    r"\[(?:hier|bitte)\b[^\[\]\n]++\]|\[[^\[\]\n]+?\b(?:einsetzen|einfügen|eintragen|eingeben)\]",
    r"\[(?:insérer|insérez|saisir|saisissez|indiquer|votre|ici)\b[^\[\]\n]*+\]",
    r"\[(?:insertar|inserte|introduzca|introducir|escriba|indique|su|tu|aquí)\b[^\[\]\n]*+\]",
    r"[【\[［](?:此处|在此|请在此|请)[^】\]］\n]*+[】\]］]",
    r"\b(?:TODO|FIXME|TBD)\s*\([^()\n]++\)",
    r"(?<![\w/])[X]{2}/[X]{2}/[X]{2,4}(?![\w/])|(?<!\w)(?:DD|MM)/(?:DD|MM)/YYYY(?!\w)",
]
# Names of HTML elements, which are no template fields when written as <name>.
HTML_NAMES = (
    "a abbr address area article aside audio b base body br button canvas caption center cite code col div dl dt dd em"
    " embed fieldset figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label"
    " legend li link main map meta nav noscript object ol option p param pre q ruby s samp script section select small"
    " span strike strong style sub sup table tbody td template textarea tfoot th thead tr tt u ul var video wbr"
).split()
# The words of the usual pseudo-Latin filler.
LATIN_FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna"
    " aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis"
    " aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat"
    " cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()

_FIELD = regex.compile("|".join(f"(?:{p})" for p in FIELD_PATTERNS))
_FIELD_ANY_CASE = regex.compile("|".join(f"(?:{p})" for p in FIELD_PATTERNS if p.startswith((r"\[(?:", r"<!--"))), regex.I)
#: Every field pattern needs one of these.
_FIELD_SIGN = regex.compile(r"[{}<\[\]【［$%@«‹]|&lt;|__|TODO|FIXME|TBD|XX/|/YYYY")
_ANGLE = regex.compile(r"<([a-z]+(?:_[a-z]+)*)>")
_TAG = regex.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]{0,200})?/?>|<!DOCTYPE[^<>]{0,100}>", regex.I)
_WORD = regex.compile(r"[\p{Han}]|[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
_SPLIT = regex.compile(r"[\r\n\u2028\u2029\u0085]+|(?<=[.!?…]['\"”»)]?)\s+|(?<=[。！？])")

_SCRIPT_THING = r"supported browser|browser (?:too old|not supported)|java\s?script|\bjs\b|\bscripts?\b|\bscripting\b|active content|\bskripte?\b|aktive inhalte|\bcontenu actif\b|contenido activo|脚本|活动内容"
_SCRIPT_ASK = (
    r"\b(?:enable|activate|allow|permit|turn (?:it )?on|switch(?:ed)? (?:on|off)|need|requires?|must|have to|disabled|blocked|"
    r"off|support|supported|detected|without|unblock|deactivated|aktivier\w*|einschalten|zulassen|erlauben|benötig\w*|deaktiviert|"
    r"activ\w+|autoris\w+|désactiv\w+|nécessite|habilit\w+|permit\w*|desactiv\w+|requiere|necesita|déblo\w+|bloqu\w+)\b|启用|开启|打开|允许|需要|禁用|关闭|sans (?:java)?scripts?\b|ne peut (?:pas )?s.afficher"
)
_THING, _ASK = regex.compile(_SCRIPT_THING, regex.I), regex.compile(_SCRIPT_ASK, regex.I)

_REASON = (
    r"bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file |document )?not found|method not allowed|not acceptable|"
    r"request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|"
    r"gateway time-?out|moved permanently|unprocessable entity|access denied|request entity too large"
)
_ERRORS = [
    rf"^\W*(?:http(?:/\d(?:\.\d)?)?|error|status|code|fehler|erreur)?\W*(?:code\W*)?(?:[1-5]\d\d)\W+(?:{_REASON})\b.{{0,40}}$",
    rf"^\W*(?:error\W+)?(?:{_REASON})\W*(?:[1-5]\d\d)?\W*$",
    r"^\W*(?:http(?:/\d(?:\.\d)?)?|error|status|reason|host|content-type|server|date|connection|request id|ray id|retry-after|cache-control)\W*[:=/]\s*\S.{0,80}$",
    r"^\W*(?:http(?:/\d(?:\.\d)?)?|error|fehler|erreur|code|错误)\W*(?:code\W*)?[1-5]\d\d\b.{0,40}$",
    r"\bserver returned (?:status|error|an? )|returned status \d+|status code \d+",
    r"upstream connect error|disconnect/reset before headers|reset reason|connection (?:refused|reset|timed out|failure)|no healthy upstream",
    r"^\W*traceback \(most recent call last\)|^\W*file \".{1,80}\", line \d+|^\W*(?:[A-Z]\w*(?:Error|Exception))\b.{0,120}$|^\W*at [\w.$<>]+\(.{0,60}\)",
    r"(?:fatal|parse|syntax|runtime) error\b|uncaught (?:\w+ ?)?exception|unhandled exception|null ?pointer|segmentation fault|stack trace|core dumped",
    r"error establishing a database|database (?:error|connection)|sqlstate|syntax error|access to the path|permission denied",
    r"nosuchkey|nosuchbucket|accessdenied|the (?:specified )?key does not exist|invalidargument",
    r"^\W*\{.{0,40}\b(?:status|error|code|message)\b.{0,160}\}\W*$",
    r"(?:it|page|document|article|file) (?:may|might|could) have been (?:moved|removed|deleted|renamed)|rate.?limit(?:ed|ing)?\b|request id\b|checking (?:that|if|whether) you are|you are (?:a )?human|verify (?:that )?you|this may take a few|^\W*oops\b|^\W*nothing (?:was )?(?:here|found)|session (?:has )?(?:expired|timed|ended)|(?:log|sign) ?in (?:again|to continue|first)|captcha|unusual traffic|quota exceeded|(?:scheduled|planned|under) maintenance|(?:servers?|site|service) (?:is|are) down|we.ll be (?:right )?back|be back (?:shortly|soon)|(?:url|request) was (?:rejected|blocked)|support (?:number|id) is",
    r"interner fehler|fehler bei der|sitzung (?:ist )?abgelaufen|melden sie sich|votre session|session a expiré|erreur lors|su sesión|sesión ha (?:caducado|expirado)|会话已(?:过期|失效)|重新登录|正在(?:检查|验证)|内部错误|处理(?:请求)?时",
    r"something went wrong|unexpected error|an error (?:has )?occurred|internal error|technical (?:difficult|problem)",
    r"(?:try|check) (?:again|back) (?:later|soon|in a)|please try again|if the problem persists|contact (?:the|your) (?:site |system |web ?)?(?:administrator|owner|webmaster)|write to the administrator|return to the (?:start|home) ?page|go back (?:to|home)|reload (?:the|this) page|reference (?:id|number|code)|^\W*(?:incident|ticket|trace|ref)\b.{0,30}$",
    r"(?:you )?(?:do not|don't) have (?:the )?permission|access (?:is |has been )?(?:denied|restricted|forbidden)|not authori[sz]ed to",
    r"\b(?:page|document|article|request|site|resource|file|link|url|server|service|session|record|entry|content|website|address)\b(?:.{0,40})\b(?:could not be|cannot be|can't be|was not|were not|is not|isn't|no longer|does not|doesn't|did not|has been (?:blocked|removed|deleted|moved|disabled)|has expired|expired|timed out|temporarily|unavailable|failed|missing|not available|ended with|ran into|is down|not respond|overloaded)",
    r"(?:cannot|can't|could not|unable to|failed to) (?:be )?(?:display|load|open|find|found|reach|process|complete|connect|show|retrieve|fetch)",
    r"seite (?:wurde |konnte |ist )?(?:nicht|leider)|angeforderte seite|nicht gefunden|zurück zur startseite|serverfehler|ein fehler ist aufgetreten|fehler aufgetreten|später (?:noch einmal|erneut|wieder)|versuchen sie es|zugriff verweigert|keine berechtigung|nicht verfügbar|zeitüberschreitung",
    r"page demandée|introuvable|retour à l.accueil|erreur (?:inattendue|interne|du serveur|s.est)|s.est produite|veuillez réessayer|réessayez|accès (?:refusé|interdit)|indisponible|plus tard\W*$|pas l.autorisation|n.existe (?:pas|plus)",
    r"página (?:solicitada|no )|no se (?:ha )?(?:encontr\w+|pudo)|error en el servidor|se ha producido un error|inténtelo|inténtalo|acceso denegado|volver al inicio|no disponible|no tiene permiso|ya no existe|tiempo de espera",
    r"服务器(?:繁忙|错误|内部|无响应|暂时)|请稍后(?:再试|重试)|错误代码|页面(?:不存在|未找到|无法|已被|找不到)|找不到(?:该|您|页面|网页)|没有权限|访问被拒绝|无法(?:访问|显示|加载|找到|打开)|出错了|发生(?:了)?(?:未知|意外)?错误|您(?:请求|访问|要找)的|返回首页|拒绝访问|系统(?:繁忙|错误|异常)|连接超时|请求超时",
]
_ERROR = regex.compile("|".join(f"(?:{p})" for p in _ERRORS), regex.I)

_FILLERS = [
    r"your (?:\w+ )?(?:text|content|title|description|headline|name|article|paragraph|copy) (?:goes |comes |will go |belongs )?here",
    r"(?:sample|example|dummy|placeholder|filler|test|default|temporary) (?:text|content|copy|paragraph|sentence|entry|article|page|description)",
    r"replace (?:it|this|me|them|the text)|(?:to|must|should) be (?:replaced|filled in|written|completed|added)|lorem ipsum",
    r"(?:description|content|text|article|details?|page|biography|more)\b.{0,20}\bcoming soon|coming soon|under construction|check back (?:later|soon)|to be (?:announced|determined|added)|this (?:page|section|article) is (?:empty|intentionally|a stub)|nothing (?:here|to see)|click (?:here )?to (?:edit|add)|edit this text|double[- ]click to edit",
    r"(?:heading|headline|title|subtitle|body|copy|text|content|name|caption|image|quote|summary|link)s? goes? here|to be supplied|supplied by the (?:editor|author)|(?:write|add|enter|type|insert|describe|put)\b.{0,60}\bhere\b|what are they known for|when (?:were|was) (?:they|he|she|it) (?:born|founded)",
    r"blindtext|platzhalter|beispieltext|mustertext|fülltext|hier steht|hier (?:folgt|entsteht|kommt)|in kürze|\bmuster(?: \w+)? \d+|sagt nichts aus|noch kein(?:e)? (?:text|inhalt)",
    r"texte? (?:de remplissage|d.exemple|factice|provisoire|fictif)|faux texte|(?:doit|à) (?:être )?remplac\w+|bientôt disponible|en construction|votre texte",
    r"texto (?:de relleno|de ejemplo|de muestra|provisional|simulado)|debe (?:sustituirse|reemplazarse|ser )|sustituy\w+|próximamente|en construcción|su texto aquí|tu texto",
    r"占位(?:文字|文本|符)|示例(?:文字|文本|内容|段落)|请替换|测试(?:文字|文本|内容|数据|测试)|敬请期待|即将(?:推出|上线)|此处(?:为|填写|输入|添加)|(?:在此|这里)(?:输入|填写|添加)|样例文本|内容(?:建设中|待补充|待完善|更新中)|暂无(?:内容|简介)|正文内容|待(?:补充|填写|完善)",
    r"the quick brown fox|^\W*(?:asdf|qwert?y?|foo|xxx|abc|test|blah|jkl)\b(?:\W+(?:asdf|qwert?y?|foo|bar|baz|xxx|abc|tests?|blah|jkl|more|to|follow|\d+)\b)*\W*$|\bblah,? blah\b",
    r"^\W*(?:example|sample|test|muster|beispiel|exemple|ejemplo|dummy)\b \p{L}+(?: \d+)?\W*$|^\W*(?:lastly|first|next|also|another|finally|and)\b.{0,12}\b(?:example|sample|dummy|test)\b.{0,30}$",
]
_FILLER = regex.compile("|".join(f"(?:{p})" for p in _FILLERS), regex.I)
_FURNITURE = regex.compile(
    r"^\W*(?:skip to (?:main )?content|menu|home|loading\W*|back to top|search|log ?in|sign (?:in|up)|share|print|about|contact|privacy.{0,20}|terms.{0,20}|"
    r"all rights reserved|©.{0,80}|copyright.{0,80}|powered by.{0,60}|cookie.{0,40}|please wait\W*|welcome\b.{0,30}|navigation|footer|header|archive|date|[\d\W]+)\W*$|\|.*\||^.{1,40}›.{1,60}$",
    regex.I,
)
#: Signs of a sentence that tells about a page, a script or a filler instead of being one.
_TOLD = regex.compile(
    r"《[^》]+》|\b(?:in|until|since|before|after|bis|seit|im jahr|en|jusqu.en|depuis|hasta|desde) (?:1[5-9]|20)\d\d\b|"
    r"\b(?:taught|wrote|rewritten|known for|repaired|was cut|delegates|villages|forbidden to|drawing of|habit that|asked|"
    r"verlangt|schrieb|nannte|appela|revient|exige que|se pidió|llamó|escribió|écrivit)\b|讲述|借自",
    regex.I,
)
_LATIN = set(LATIN_FILLER)


def _one_off(word: str) -> bool:
    """A filler word with up to two slips: compared by its letter pairs, so the test costs one pass."""
    pairs = {word[i : i + 2] for i in range(len(word) - 1)}
    return any(abs(len(word) - len(o)) <= 2 and 2 * len(pairs & p) >= len(pairs | p) * 0.8 for o, p in _LATIN_PAIRS)


_LATIN_PAIRS = [(w, {w[i : i + 2] for i in range(len(w) - 1)}) for w in LATIN_FILLER if len(w) > 3]


def _is_filler(words: list[str]) -> bool:
    """Pseudo-Latin, or the same words again and again."""
    if len(words) >= 4:
        exact = sum(w in _LATIN for w in words)
        if exact >= 2 and sum(w in _LATIN or (len(w) > 3 and _one_off(w)) for w in words) >= 0.6 * len(words):
            return True
        kinds = len({w for w in words if not w.isdigit()})
        if len(words) >= 4 and kinds <= max(1, len(words) // 3):  # the same word again and again
            return True
    return False


def has_field(text: str) -> bool:
    """True if the text holds an unfilled template field."""
    if not _FIELD_SIGN.search(text):
        return False
    if _FIELD.search(text) or _FIELD_ANY_CASE.search(text):
        return True
    for m in _ANGLE.finditer(text):
        name = m.group(1)
        if name not in HTML_NAMES and f"</{name}>" not in text:
            return True
    return False


def _clean(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return regex.sub(r"[­​-‏⁠﻿]", "", text)


def _segment_kinds(segments: list[tuple[str, list[str]]]) -> list[str | None]:
    """script, error, filler or None of each segment. The long lists of wordings run in one pass over all segments."""
    if len(segments) < FEW:  # the pass would cost more than it saves
        error, filler = [bool(_ERROR.search(t)) for t, _ in segments], [bool(_FILLER.search(t)) for t, _ in segments]
    else:
        text = pa.array([t for t, _ in segments], pa.string())
        error, filler = (pc.match_substring_regex(text, p, ignore_case=True).to_pylist() for p in (_ERROR_RE2, _FILLER_RE2))
    out: list[str | None] = []
    for (t, words), is_error, is_filler in zip(segments, error, filler, strict=True):
        if _THING.search(t) and _ASK.search(t):
            kind = "script"
        else:
            kind = "error" if is_error else "filler" if is_filler or _is_filler(words) else None
        out.append(None if kind and _TOLD.search(t) else kind)
    return out


#: Segments under which the lists of wordings run one by one.
FEW = 50
_ERROR_RE2, _FILLER_RE2 = _ERROR.pattern, _FILLER.pattern.replace(r"\p{L}", r"\pL")


def _segments(plain: str) -> Iterator[tuple[str, list[str]]]:
    for t in _SPLIT.splititer(plain):
        t = t.strip() if t else ""
        words = _WORD.findall(t.lower())
        if words:
            yield t, words


class _Reading:
    """How far a text has been read, and what was found in it."""

    def __init__(self, text: str):
        plain = _clean(text)
        self.markup = plain.lstrip().startswith("<")
        self.segments = _segments(_TAG.sub("\n", plain) if "<" in plain else plain)
        self.found: dict[str, int] = {}
        self.content = 0

    def next(self) -> list[tuple[str, list[str]]]:
        """Segments of some more words than settle a real text."""
        out, n = [], 0
        for t, words in self.segments:
            out.append((t, words))
            n += len(words)
            if n > 15:
                break
        return out

    def take(self, segment: str, words: list[str], kind: str | None) -> bool:
        """False if the text is a real one."""
        if kind:
            self.found[kind] = self.found.get(kind, 0) + len(words)
        elif not (_FURNITURE.search(segment) or (len(words) <= 8 and not _ENDS.search(segment))):
            self.content += len(words)
        return self.content <= 12

    def kind(self) -> str | None:
        if not self.found or self.content > 0.25 * sum(self.found.values()):
            return None
        best = max(self.found, key=lambda k: (self.found[k], k))
        return best if sum(self.found.values()) >= 3 or self.markup or best in ("error", "script") else None


_ENDS = regex.compile(r"[.!?。！？]\W*$")


def kinds_of(texts: list[str | None]) -> list[str | None]:
    """field, script, error or filler of each text; None for anything else, null and blank texts included.

    A text is script, error or filler if at least one of its sentences is and the rest are page furniture: short lines
    without a sentence, such as headings, menus and footers. One sentence of real content makes it a real text. Texts are
    read to the end or to the sentence that settles them.
    """
    out: list[str | None] = [None] * len(texts)
    open_: list[tuple[int, _Reading]] = []
    for i, t in enumerate(texts):
        if t and t.strip():
            if has_field(t):
                out[i] = "field"
            else:
                open_.append((i, _Reading(t)))
    while open_:
        read = [(i, r, r.next()) for i, r in open_]
        kinds = iter(_segment_kinds([s for _, _, part in read for s in part]))
        open_ = []
        for i, r, part in read:
            marks = [next(kinds) for _ in part]
            if not part:
                out[i] = r.kind()
            elif all(r.take(t, w, k) for (t, w), k in zip(part, marks, strict=True)):
                open_.append((i, r))
    return out


def kind_of(text: str | None) -> str | None:
    """`kinds_of` a single text."""
    return kinds_of([text])[0]


#: Lines that are markup or furniture, in the syntax of RE2 (whose \W knows ASCII only).
_FURNITURE_RE2 = "(?im)" + _FURNITURE.pattern.replace(r"[\d\W]", r"[^\pL]").replace(r"\W", r"[^\pL\pN\n]").replace(".", "[^\n]").replace("\\[^\n]", "\\.")
_PLAIN_WORD = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^\W_]+(?:['’\-][^\W_]+)*")
_P = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _P[1]
    h = (h ^ (h >> np.uint64(27))) * _P[2]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of SHINGLE words, of all words where there are fewer; markup
    and furniture are left out unless there is nothing else."""
    low = pc.utf8_lower(pc.utf8_normalize(pa.array(texts, pa.string()), form="NFKC"))
    core = pc.replace_substring_regex(pc.replace_substring_regex(low, r"</?[a-z!][^<>]*>", "\n"), _FURNITURE_RE2, "").to_pylist()
    lists = [_PLAIN_WORD.findall(text) or _PLAIN_WORD.findall(whole) for whole, text in zip(low.to_pylist(), core, strict=True)]
    # the words of all texts in one array; each text's runs are a slice of it
    words = pa.array([w for ws in lists for w in ws], pa.string()).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h = np.concatenate([own[words.indices.to_numpy()], np.zeros(SHINGLE, np.uint64)])
    runs = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        runs += h[i : i + len(runs)] * _P[i]
    runs = _mix(runs)
    out, at = [], 0
    for ws in lists:
        if len(ws) >= SHINGLE:
            out.append(np.unique(runs[at : at + len(ws) - SHINGLE + 1]))
        else:  # all words make one
            out.append(_mix((h[at : at + len(ws)] * _P[: len(ws)]).sum(dtype=np.uint64, keepdims=True)))
        at += len(ws)
    return out


def simhash(shingles: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of 64 * words bits, as signed 64-bit words; its bits are independent of each other."""
    ones = np.zeros(64 * words, np.int64)
    seeds = _mix(np.arange(1, words + 1, dtype=np.uint64) * _P[0])
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        bits = np.unpackbits(_mix(part[:, None] ^ seeds).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(shingles)).view(np.int64)


def table_plan(texts: int, found: float = FOUND) -> tuple[int, int]:
    """Bits of a key and number of tables for so many texts: the bits grow with the logarithm of the texts, so buckets stay
    small, and the tables with them, so a pair at SIMILARITY shares a key with the same probability at every size."""
    bits = max(12, math.ceil(math.log2(max(texts, 1) / 16)))
    return bits, math.ceil(math.log(1 - found) / math.log(1 - BIT_AGREES**bits))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays or [np.empty(0, np.uint64)]).view(np.int64)))


def text_marks(docs: DataFrame, words: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, vid (stands for an exact text), kind, n (number of shingles), low (its least shingles) for every text that is neither
    null nor blank. Two similar texts share one of `low`: as many as either may have besides those in common, and one more.
    words has no effect any more: SimHashes are made of the few texts that share one (`_sketches`)."""
    kind_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            at: dict[str, int] = {}
            for t in texts:
                at.setdefault(t, len(at))
            distinct = list(at)
            sets = shingle_sets(distinct)
            vid = np.array([xxhash.xxh64_intdigest(t) for t in distinct], np.uint64).view(np.int64)
            low = _lists([s[: len(s) - math.ceil(SIMILARITY * len(s) - 1e-9) + 1] for s in sets])
            rows = pa.array([at[t] for t in texts], pa.int32())
            cols = [pa.array(vid), pa.array(kinds_of(distinct), pa.string()), pa.array([len(s) for s in sets], pa.int32()), low]
            yield pa.RecordBatch.from_arrays([b.column("k"), *[c.take(rows) for c in cols]], ["k", "vid", "kind", "n", "low"])

    narrow = docs.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = spread(narrow).mapInArrow(run, f"k {kind_type}, vid bigint, kind string, n int, low array<bigint>")
    return out.withColumnRenamed("k", key)


def _sharing(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of which a member of `low` is in `low` of one of `others`, and few more: a Bloom filter of 2 ** FILTER bits tells."""
    mask = (1 << FILTER) - 1
    h = others.select(F.explode("low").alias("h"))
    step = F.shiftrightunsigned("h", FILTER).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(1))
    at = h.select(F.explode(F.array(*[(F.col("h").bitwiseAND(F.lit(mask)) + i * step).bitwiseAND(F.lit(mask)) + 1 for i in range(TRIES)])).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(1 << (FILTER - 3), np.uint8)
    for part, own in parts.toLocalIterator():
        bits[(part - 1) * len(own) : part * len(own)] = np.frombuffer(own, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            if b.num_rows:
                low = b.column("low")
                h = low.flatten().to_numpy().view(np.uint64)
                step = (h >> np.uint64(FILTER)) & np.uint64(mask) | np.uint64(1)
                known = np.ones(len(h), bool)
                for i in range(TRIES):
                    at = (h & np.uint64(mask)) + np.uint64(i) * step & np.uint64(mask)
                    known &= (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                yield b.filter(pa.array(np.logical_or.reduceat(known, low.offsets.to_numpy()[:-1] - low.offsets[0].as_py())))

    return rows.mapInArrow(run, rows.schema)


def _keys(bits: int, tables: int):
    """An array of the keys of all tables: table number, and `bits` bits of the SimHash of its own."""

    def cut(t: int):
        word, shift = divmod(t * bits, 64)
        own = F.shiftrightunsigned(F.col("sim")[word], shift)
        if shift + bits > 64:
            own = own.bitwiseOR(F.shiftleft(F.col("sim")[word + 1], 64 - shift))
        return own.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(t << bits))

    return F.array(*[cut(t) for t in range(tables)])


def near_texts(front: DataFrame, free: DataFrame, bits: int, tables: int, steps: list[DataFrame] | None = None) -> Iterator[DataFrame]:
    """vid, kind, u: pairs of a text of `front` (vid, kind, n, band, sim) and one of `free` (the same, without kind) that share a
    key, have sizes that allow the similarity and nearly the same SimHash. A bucket's labelled texts come in slices of
    about SLICE, one DataFrame per slice, so that no bucket makes all its pairs at once; the caller takes what it has labelled
    out of `free` in between (`steps` holds the current `free`)."""
    size = 64 * math.ceil(bits * tables / 64)
    most = int((1 - BIT_AGREES) * size + SPARE * math.sqrt(BIT_AGREES * (1 - BIT_AGREES) * size))
    keyed = front.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    keyed = keyed.select("vid", "kind", "n", "sim", "band", F.explode(_keys(bits, tables)).alias("key"))
    counts = keyed.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    keyed = keyed.join(counts, ["band", "key"]).withColumn("slice", F.pmod(F.xxhash64("vid"), F.col("slices")).cast("int"))
    # each bucket is one row on this side, so a hot one only splits the other
    held = stage(keyed.groupBy("band", "key", "slice").agg(F.collect_list(F.struct("vid", "kind", "n", "sim")).alias("held")), "buckets")
    last = held.agg(F.max("slice")).first()[0]
    for s in range(0 if last is None else last + 1):
        now = held.where(F.col("slice") == s).select("band", "key", "held")
        free = steps[-1] if steps else free
        asked = free.select(F.col("vid").alias("u"), F.col("n").alias("un"), F.col("sim").alias("usim"), "sim", "band").withColumn("key", F.explode(_keys(bits, tables))).drop("sim")
        differ = lambda x: F.aggregate(F.zip_with(x["sim"], F.col("usim"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, d: a + d)
        sized = lambda x: (F.col("un") >= SIMILARITY * x["n"] - 1e-9) & (x["n"] >= SIMILARITY * F.col("un") - 1e-9)
        met = asked.join(now, ["band", "key"]).select("u", F.explode(F.filter("held", lambda x: sized(x) & (differ(x) <= most))).alias("x"))
        yield met.groupBy("x.vid", "u").agg(F.min("x.kind").alias("kind"))
    drop_stage(held)


def spread_labels(marks: DataFrame, docs: DataFrame, plan: tuple[int, int], text: str = "text") -> DataFrame:
    """vid, kind of texts that a chain of near-duplicates connects with a text whose kind holds for the whole text.

    marks: staged result of `text_marks`; docs has the texts. A template field is no label of the whole text (the article
    around it has sound near-duplicates), so it does not spread. Only texts that share one of their least shingles with one
    of the other side can have a near text there; only they are read again, hashed and met.
    """
    nodes = marks.select("vid", "kind", "n", "low", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int").alias("band"))
    once = lambda df: df.groupBy("vid").agg(*[F.first(c).alias(c) for c in df.columns if c != "vid"])
    front = stage(once(nodes.where(F.col("kind").isin("script", "error", "filler"))), "front")
    found = sketches = None
    for step in itertools.count(1):
        bands = sorted({r.band + d for r in front.select("band").distinct().collect() for d in (-1, 0, 1)})  # the logarithm of a length
        free = _sharing(nodes.where(F.col("kind").isNull() & F.col("band").isin(bands)).drop("kind"), front)
        if found is not None:
            free = free.join(found, "vid", "left_anti")
        free = stage(once(free), "may-be-near")
        shared = free.select("vid", F.explode("low").alias("h")).join(front.select(F.explode("low").alias("h")).distinct(), "h", "left_semi")
        free = stage(free.join(shared.select("vid").distinct(), "vid", "left_semi"), "may-be-near")
        front = stage(_sharing(front, free), "front")
        ids = front.select("vid").union(free.select("vid"))
        more = stage(_sketches(marks, docs, ids if sketches is None else ids.join(sketches, "vid", "left_anti"), text, math.ceil(plan[0] * plan[1] / 64)), "sketches")
        sketches = more if sketches is None else sketches.unionByName(more)
        sims = sketches.select("vid", "sim")
        reach, free = free, stage(free.drop("low").join(sims, "vid"), "free-texts")
        steps, new = [free], None
        for near in near_texts(front.drop("low").join(sims, "vid"), free, *plan, steps):
            near = stage(near, "near-texts")
            if not near.isEmpty():
                part = stage(_verified(near, sketches), "labelled")
                if not part.isEmpty():
                    new = part if new is None else new.unionByName(part)
                    found = part if found is None else found.unionByName(part)
                    steps.append(free.join(found, "vid", "left_anti"))
            drop_stage(near)
        if new is None:
            break
        if step % 10 == 0:  # a long chain makes no long plan
            found, sketches = stage(found, "labelled"), stage(sketches, "sketches")
        front = stage(reach.join(new, "vid"), "front")
    return found if found is not None else nodes.select("vid", "kind").limit(0)


def _verified(near: DataFrame, sketches: DataFrame) -> DataFrame:
    """vid, kind: the texts u of `near` (vid, kind, u) whose shingles are similar to those of vid."""
    a, b = (sketches.select(F.col("vid").alias(n), F.col("s").alias(f"{n}_s")) for n in ("vid", "u"))
    both = F.size(F.array_intersect("vid_s", "u_s"))
    return (
        near.join(a, "vid").join(b, "u")
        .where(both >= SIMILARITY * (F.size("vid_s") + F.size("u_s") - both) - 1e-9)
        .groupBy(F.col("u").alias("vid")).agg(F.min("kind").alias("kind"))
    )


def _sketches(marks: DataFrame, docs: DataFrame, ids: DataFrame, text: str, words: int) -> DataFrame:
    """vid, s (shingles), sim (SimHash of 64 * words bits) of the texts in `ids`, each text read from one of its rows."""
    key = marks.columns[0]
    ids = stage(ids.distinct(), "ids")
    few = ids.count() <= FEW_IDS  # then no text is shuffled to find them
    rows = stage(marks.select(key, "vid").join(F.broadcast(ids) if few else ids, "vid", "left_semi").groupBy("vid").agg(F.min(key).alias(key)), "rows")

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("t").to_pylist())
            sims = [simhash(s, words) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("vid"), _lists(sets), _lists(sims)], ["vid", "s", "sim"])

    texts = docs.select(key, F.col(text).alias("t")).join(F.broadcast(rows) if few else rows, key).groupBy("vid").agg(F.first("t").alias("t"))
    return texts.mapInArrow(run, "vid bigint, s array<bigint>, sim array<bigint>")


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, how of every text that is residue: kind is field, script, error or filler, how is rule or spread.

    Null, blank and very short texts never are. Rows come out as often as they come in; a null key is kept. Other
    columns are ignored, an empty table gives no rows. `docs` should be a scan or a staged table, it is read again for
    the texts of near-duplicates.
    """
    plan = table_plan(docs.count())
    marks = stage(text_marks(docs, key=key, text=text), "text-marks")
    more = spread_labels(marks, docs, plan, text)
    own = marks.where(F.col("kind").isNotNull()).select(key, "kind", F.lit("rule").alias("how"))
    rest = lookup_join(marks.where(F.col("kind").isNull()).select(key, "vid"), more, ["vid"]).select(key, "kind", F.lit("spread").alias("how"))
    return own.unionByName(rest)


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are residue, with the kind, and whether a rule or a near-duplicate told it."""
    return residue(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or demands for scripts."""
    return p8_kinds(spark, sf_dir).select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_kinds": p8_kinds}
SQL: dict[str, str] = {}
