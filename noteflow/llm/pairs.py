"""Problem 2: defective question-answer pairs, each with its type of defect.

Labelling functions look at one sign each and vote on a pair, for each defect: 1 (defective), -1 (sound), 0 (no opinion).
A label model per defect (two latent classes, votes independent given the class) is fitted by expectation maximization
on the counts of vote patterns, which are at most 3 ** functions rows however many pairs there are. It starts from
pairs with known labels: defects are planted into all pairs that no function suspects. A pair keeps every label whose
posterior reaches the defect's cutoff; the cutoff is the one with the best F1 on planted pairs that the start did not
see. The language of a text comes from a naive Bayes model fitted on the word counts of all labelled documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.functions.runtime import spread, stage, table
from noteflow.operators.references import latest

DEFECTS = ["empty", "refusal", "copies_question", "other_language", "truncated"]
#: Pairs that one group of `plant` has, about; half of all set the start of the label models, half the cutoffs.
PLANTED_ROWS = 6000
#: Words to which the counts of a language are scaled.
COUNTED = 150_000
#: The planted pairs of a class weigh as much as this share of all pairs in a step of the label model.
KNOWN_SHARE = 0.1
LANGUAGES = ["en", "de", "fr", "es"]

_HAN = regex.compile(r"\p{Han}")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
_TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{M}\p{N}]+")
_QUOTED = regex.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|《[^》]*》|「[^」]*」|\([^()]*\)|（[^（）]*）")
_TITLE = regex.compile(r"\b\p{Lu}[\p{L}'’\-]*(?: (?:(?:the|a|an|of|for|from|on|and|at|in|to|&) ){1,3}\p{Lu}[\p{L}'’\-]*)+|\b(?:A|An|The|Beyond|Notes|Letters)(?: (?:the|a|an|on|from|of|for|and|\p{Lu}[\p{L}'’\-]*))* \p{Lu}[\p{L}'’\-]*")

# Stand-ins for a missing value, labels without an answer.
STAND_INS = "n/a na nan null none nil empty blank missing undefined void tbd unknown unanswered no_answer noanswer 无 空 暂无 不详 nichts leer vide vacío".split()
LABELS = "answer response reply result output a ans antwort réponse respuesta 答案 回答 答".split()
# What the batch run writes instead of an answer.
NOTICES = regex.compile(
    r"^\W*(?:no answer (?:was )?(?:found|produced|given|available|generated|possible)|processing (?:failed|timeout|error|timed out)|(?:an )?error (?:has )?occurred.*|"
    r"(?:request |generation |model )?(?:timed out|timeout|failed|failure|aborted)|insufficient (?:evidence|information|context|data)|unanswerable|not answerable|"
    r"(?:it |this )?(?:cannot|can not|can't|could not) be (?:determined|answered|established).{0,40}|not (?:stated|mentioned|specified|provided|given|found|available|enough).{0,60}|"
    r"unknown\W+(?:not|no)\b.{0,60}|the (?:model|system|run|service) (?:declined|refused|failed|did not|timed out|returned)\b.*|no (?:information|evidence|context|relevant).{0,60})\W*$",
    regex.I,
)
_DECLINE = {
    "en": r"\bi(?:'m| am)? (?:really |do |must |have to |will |would |can )?(?:sorry|afraid|unable|not able|cannot|can't|won't|don't|do not|decline|not (?:going|comfortable|in a position)|must decline|rather not|prefer not|refuse)\b|"
    r"no answer can be given|not (?:something|a topic) i (?:can|will)|not possible to (?:determine|say|answer|tell)|not enough (?:evidence|information|context)|(?:won't|not) speculate|leave the field blank|inventing things|rather not guess|beyond my",
    "de": r"kann (?:ich )?(?:\S+ ){0,4}nicht (?:beantworten|sagen|helfen|beurteilen)|darf ich (?:\S+ ){0,3}nichts?|geht (?:\S+ ){0,6}nicht hervor|keine (?:ausreichenden )?(?:angaben|informationen|auskunft)|reichen (?:\S+ ){0,4}nicht aus|möchte ich (?:\S+ ){0,3}nicht|liegen mir (?:\S+ ){0,4}(?:keine|nicht)|lässt sich (?:\S+ ){0,6}nicht|fragen sie (?:\S+ ){0,2}anderswo|weiß ich nicht|enthalten (?:\S+ ){0,4}nichts?",
    "fr": r"ne (?:peux|puis|saurais|dispose|permet\w*|veux) (?:\S+ ){0,2}(?:pas )?|préfère ne pas|n'ai pas (?:assez|suffisamment|la)|pas assez d'informations?|aucune information|ne (?:disent|contiennent|mentionnent|précisent) (?:rien|pas)|consulter une autre source|impossible de (?:répondre|dire|savoir)|ne pas me prononcer",
    "es": r"no puedo (?:responder|contestar|ayudar|decir)|no dispongo|prefiero no|no (?:me )?(?:permiten|es posible|hay (?:información|datos) suficiente|tengo (?:información|datos))\w*|consulte otra fuente|no (?:dicen|mencionan|contienen) nada|no sabría|no estoy en condiciones",
    "zh": r"(?:无法|不能|不便|没法|不予)(?:回答|作答|对此|确定|提供|判断|发表|得知|评论|给出)|信息不足|没有(?:提供|提到|足够|相关|给出)|未(?:提及|提供|说明|给出)|请查阅其他|不便对此|无从(?:得知|判断)|不清楚|我不知道",
}
_DECLINE_ANY = regex.compile("|".join(f"(?:{p})" for p in _DECLINE.values()), regex.I)
_APOLOGY = regex.compile(r"^\W*(?:(?:i'm |i am )?(?:so |very )?sorry|apologies|unfortunately|regrettably|as an? (?:ai |language )?(?:assistant|model)|leider|(?:es tut mir|tut mir) leid|entschuldigung|désolée?|malheureusement|je regrette|lo siento|lamentablemente|por desgracia|perdón|抱歉|很遗憾|对不起|很抱歉|遗憾)", regex.I)
_SILENT = regex.compile(
    r"\b(?:passages?|notes?|documents?|sources?|context|texts?|paragraphs?|material|evidence|excerpts?)\b.{0,40}\b(?:do(?:es)? not|don't|doesn't|never|silent|too thin|no clue|contains? no|contains? nothing|nothing|leaves? (?:this|it) open|incomplete|insufficient|says? nothing|no (?:information|evidence|answer|hint|mention))\b|"
    r"\b(?:textes?|passages|textos|pasajes|abschnitte|quellen)\b.{0,30}\b(?:ne|no|nicht|keine)\b|段落.{0,6}(?:没有|未|不)",
    regex.I,
)
_FRAME = set(
    "question questions q a answer you asked ask wanted want know your the is was as to here re regarding frage fragen sie fragten gefragt ihre die zur antwort lautet wurde"
    " pregunta preguntas usted preguntó ha preguntado su la respuesta es vous avez demandé votre demande réponse est quelle à sur s so well then repeat"
    " 问 题 问题 您 你 的 是 答 回 关 于 提".split()
)
_LAST_SMALL = set("and or of the a an to in on by with from for at as but which who whom that because when where whose und oder der die das den dem von zu mit für als weil et ou de du des le la les un une à par pour dont qui que y o el los las con por para en del al cuando".split())
_END = regex.compile(r"(?<!\.\.)[.!?。！？](?:[\"'”’»)\]）」』}]|\s)*$|[\"”»」』》)\]）}]\s*$")
_ASKS_WORDS = regex.compile(r"\b(?:motto|word|title|line|abbreviation|phrase|spelling|translation|called in|wahlspruch|wort|titel|devise|mot|titre|lema|palabra|título|abreviatura)\b|题词|格言|标题|词语|缩写|哪个词", regex.I)
# Words that ask.
_ASKING = {
    "en": "who what where when why how which did does was is were many name".split(),
    "de": "wer was wo wann warum wofür wie welche welcher welches welchem hat wurde viele war ist jemals verließ nenne".split(),
    "fr": "qui que quoi où quand pourquoi combien comment quel quelle quels est était fondé né jamais nommez".split(),
    "es": "quién qué dónde cuándo cuántos cuántas cuál cómo por trabajó era fundó nació nombre".split(),
}
_YES_NO = {"en": {"yes", "no"}, "de": {"ja", "nein"}, "fr": {"oui", "non"}, "es": {"sí", "si", "no"}}


class LanguageModel:
    """Naive Bayes over lower-case words, with letter trigrams for words that the documents lack."""

    def __init__(self, rows: list[tuple[str, str]], counts: list[tuple[str, str, int]] = ()):
        """rows: language, text. counts: language, word, how often it occurs."""
        words = {l: Counter() for l in LANGUAGES}
        totals = Counter()
        for lang, _, n in counts:
            totals[lang] += n
        for lang, w, n in counts:  # as in a text of COUNTED words, so the fixed counts below weigh the same at every size
            words[lang][w] += n * COUNTED / totals[lang]
        grams = {l: Counter() for l in LANGUAGES}
        for lang, text in rows:
            for w in self.words(text):
                words[lang][w] += 1
        for l in LANGUAGES:
            words[l].update({w: 50 for w in (*_YES_NO[l], *_ASKING[l])})
            for w, n in words[l].items():
                for g in self._grams(w):
                    grams[l][g] += math.log1p(n)
        self.known = set().union(*words.values())
        self.logw = {l: {w: math.log((n + 0.05) / (sum(words[l].values()) + 1)) for w, n in words[l].items()} for l in LANGUAGES}
        self.floorw = {l: math.log(0.05 / (sum(words[l].values()) + 1)) for l in LANGUAGES}
        self.logg = {l: {g: math.log((n + 0.5) / (sum(grams[l].values()) + 1)) for g, n in grams[l].items()} for l in LANGUAGES}
        self.floorg = {l: math.log(0.5 / (sum(grams[l].values()) + 1)) for l in LANGUAGES}

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    @staticmethod
    def words(text: str) -> list[str]:
        """Words that start with a small letter: names and titles are mostly capitalised."""
        return [w for w in _WORD.findall(text) if w[0].islower()]

    def scores(self, words: list[str]) -> dict[str, float]:
        out = dict.fromkeys(LANGUAGES, 0.0)
        for w in words:
            known = w in self.known
            for l in LANGUAGES:
                if known:
                    out[l] += max(-12.0, self.logw[l].get(w, self.floorw[l]))
                else:
                    out[l] += sum(max(-10.0, self.logg[l].get(g, self.floorg[l])) for g in self._grams(w)) / 4
        return out

    def language(self, text: str) -> str:
        """Language of a whole question: zh by its script, else the best score over all its words."""
        if _is_han(text):
            return "zh"
        words = [w.lower() for w in _WORD.findall(text)]
        # the first word asks, the rest counts as far as it is no name
        known = [w for w in [*words[:1], *self.words(text)] if w in self.known]
        s = self.scores(known or words)
        return max(LANGUAGES, key=lambda l: s[l])


def _is_han(text: str) -> bool:
    han = len(_HAN.findall(text))
    return han > 0 and 2 * han >= len(regex.findall(r"\p{L}", text)) - han


def fit_language(docs: DataFrame) -> LanguageModel:
    """Fitted on all documents of a known language with 100 characters or more. Their words are counted where they are read;
    the driver gets each word of a language once."""

    def count(batches):
        seen = {l: Counter() for l in LANGUAGES}
        for b in batches:
            for l, t in zip(b.column("l").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen[l].update(LanguageModel.words(t))
        for l, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["l", "w", "n"])

    lang = F.lower(F.trim("lang"))
    labelled = spread(docs.where(lang.isin(LANGUAGES) & (F.length("text") >= 100)).select(lang.alias("l"), "text"))
    counts = labelled.mapInArrow(count, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n")).toArrow()
    return LanguageModel([], sorted(zip(*(counts[c].to_pylist() for c in ("l", "w", "n")), strict=True)))


def _bare(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return regex.sub(r"[\p{Cf}\p{Cc}]+", lambda m: " " if regex.search(r"\s", m.group()) else "", text).strip()


def _votes(question: str | None, answer: str | None, lm: LanguageModel) -> dict[str, list[int]]:
    """The votes of all labelling functions on a pair."""
    q, a = _bare(question or ""), _bare(answer or "")
    low = a.lower()
    tokens = _TOKEN.findall(low)
    quoted = _QUOTED.sub(" ", a)
    solid = any(t in low for t in ("\"", "“", "«", "„", "《"))
    words = _WORD.findall(a)
    qtokens = Counter(_TOKEN.findall(q.lower()))
    han = bool(_HAN.search(a))

    core = regex.sub(r"[^\p{L}\p{N}/_ ]+", " ", low).strip()
    nothing = not regex.search(r"[\p{L}\p{N}]", a)
    empty = [
        1 if nothing else -1,
        1 if core in STAND_INS and not (solid and core) else 0,
        1 if core in LABELS and (a.endswith((":", "：")) or len(core) > 1) and not solid else 0,
        -1 if len(tokens) > 3 else 0,
        -1 if regex.search(r"\d", a) else 0,
    ]

    titled = len(words) > 1 and all(w[0].isupper() or w in _LAST_SMALL for w in words) and sum(w[0].isupper() for w in words) >= 2 and not low.isupper() and not a.isupper()
    spoken = "" if titled else quoted  # a title says nothing
    plainly = spoken.lower().replace("’", "'")
    inside = sum((Counter(t for t in tokens if len(t) > 3 or _HAN.match(t)) & qtokens).values())
    refusal = [
        1 if NOTICES.search(a) else 0,
        1 if _DECLINE_ANY.search(plainly) else 0,
        1 if _APOLOGY.search(spoken) else 0,
        1 if _SILENT.search(spoken) else 0,
        -1 if inside >= (2 if not han else 4) else 1 if not inside else 0,
        -1 if regex.search(r"\d", a) else 0,
        -1 if solid else 0,
    ]

    held = Counter(tokens)
    shared = sum((held & qtokens).values())
    cover = shared / max(1, sum(qtokens.values()))
    # words that the question lacks, slips of its words aside
    rest = [t for t in (held - qtokens).elements() if t not in _FRAME and t not in qtokens]
    rest = [t for t in rest if not any(_slip(t, k) for k in qtokens if len(k) > 3)] if len(rest) < 12 else rest
    letters = regex.sub(r"[^\p{L}\p{N}]", "", low)
    qletters = regex.sub(r"[^\p{L}\p{N}]", "", q.lower())
    likeness = _dice(letters, qletters)
    copies = [
        1 if likeness >= 0.85 else -1 if likeness < 0.5 else 0,
        1 if cover >= 0.75 else -1 if cover < 0.6 else 0,
        1 if not rest else -1 if len(rest) >= 3 else 0,
        1 if a.rstrip("\"'”»“ ").endswith(("?", "？")) else 0,
        -1 if len(tokens) < 3 else 0,
    ]

    asked = bool(_ASKS_WORDS.search(q))
    qlang = lm.language(q) if q else "en"
    plain = _TITLE.sub(" ", quoted)
    ahan = _is_han(plain)
    small = [w for w in lm.words(plain) if w not in qtokens or w in lm.known]
    if not small and words and words[0].lower() in {"yes", "no", "ja", "nein", "oui", "non", "sí"}:
        small = [words[0].lower()]
    elif words and (words[0].lower() in lm.known and not titled and len(words) > 1):
        small = [words[0].lower(), *small]
    if asked:  # the words asked for may be in any language
        small, ahan = [], qlang == "zh"
    margin = foreign = 0.0
    if qlang != "zh" and small and not ahan:
        s = lm.scores(small)
        margin = max(s.values()) - s[qlang]
        foreign = sum(1 for w in small if w in lm.known and lm.logw[qlang].get(w, -20) < -11 and max(lm.logw[l].get(w, -20) for l in LANGUAGES) > -9)
    hanlen = len(_HAN.findall(plain))
    if qlang == "zh":
        script = 1 if not ahan and small else -1 if ahan else 0
    else:
        script = -1 if not ahan else 1 if hanlen >= 4 and not ("·" in plain and hanlen < 12) else 0
    other_language = [
        script,
        1 if margin > 4 else -1 if margin < 1 and small and script < 1 else 0,
        1 if foreign else 0,
        -1 if asked else 0,
        -1 if not (small or ahan) else 0,
    ]

    end = bool(_END.search(a))
    n = len(words) if not han else len(_HAN.findall(a)) + len(regex.findall(r"\d+", a))
    sentence = (len(small) >= 2) if not han else (n >= 9 or any(c in a for c in "，（、"))
    last = words[-1].lower() if words else ""
    dangling = n > 1 and (bool(regex.search(r"(?:[,;，；、(（\-–—…]|\.\.\.)\s*$", a)) or (last in _LAST_SMALL and not end))
    opened = any(a.count(x) > a.count(y) for x, y in ("()", "（）", "《》", "“”", "{}", "[]")) or (a.count('"') % 2 == 1)
    truncated = [
        -1 if end else 1 if sentence else 0,  # a sentence should end
        1 if dangling else 0,
        1 if opened else 0,
        1 if n >= (6 if not han else 8) else -1 if n <= 4 else 0,
        -1 if titled else 0,
    ]
    return {"empty": empty, "refusal": refusal, "copies_question": copies, "other_language": other_language, "truncated": truncated}


def _slip(a: str, b: str) -> bool:
    """True if b turns into a by a slip or two: most letter pairs are shared."""
    if abs(len(a) - len(b)) > 2 or len(a) < 3:
        return False
    return _dice(a, b) >= 0.6


def _dice(a: str, b: str) -> float:
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


#: Votes per defect, in the order of `_votes`.
FUNCTIONS = {"empty": 5, "refusal": 7, "copies_question": 5, "other_language": 5, "truncated": 5}

#: A pair is not planted into if of the first functions of a defect so many suspect it (functions, votes); what is left votes 1
#: on sound pairs too.
SUSPECT = {"empty": (5, 1), "refusal": (4, 1), "copies_question": (1, 1), "other_language": (5, 1), "truncated": (5, 2)}

# What defective answers are planted as.
PLANTED_EMPTY = ["", "   ", "-", "...", "n/a", "None", "null", "Answer:", "unknown", "无", "?", "回答："]
PLANTED_REFUSALS = [
    "I'm sorry, but I cannot answer this question.", "The passages do not say who it was.", "No answer found.", "I am unable to determine that from the text.", "The notes contain nothing about it, so no answer can be given.",
    "Das kann ich leider nicht beantworten.", "Die Abschnitte enthalten dazu nichts.", "Je ne peux pas répondre à cette question.", "Les textes ne disent rien à ce sujet.", "No puedo responder a esta pregunta.",
    "Los pasajes no dicen nada al respecto.", "抱歉，我无法回答这个问题。", "段落中没有提到相关信息，无法确定。", "Processing failed", "insufficient information", "The sources leave this question open.",
]


PLANTED_FRAMES = ["{0}", "{1}", "{2}", "You asked: {0}", "The question is: {1}", "Question: {2}.", "Sie fragten: {0}", "Die Frage lautet: {2}.", "Vous avez demandé : {1}", "Usted preguntó: {0}", "您问的是：{0}", "{3}", "{4}"]


class LabelModel:
    """Two classes, votes independent given the class, fitted by expectation maximization on counted vote patterns.

    known: patterns with labels (pattern, label, weight) that the fit starts from; in each step those of a class count
    as `KNOWN_SHARE` of the pairs, so the classes keep their meaning and every pair has a say. Ends when no posterior moves."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: list[tuple[tuple[int, ...], int, float]] = (), rounds: int = 500):
        m = patterns.shape[1]
        onehot = self._onehot(patterns)
        # without known labels a function that votes 1 is trusted to begin with
        start = np.repeat(np.array([[0.60, 0.395, 0.005], [0.02, 0.28, 0.70]])[:, None, :], m, axis=1)
        self.prior = 0.05
        self.known = np.zeros((2, m, 3))
        if known:
            for v, label, weight in known:
                self.known[label] += weight * self._onehot(np.array([v]))[0]
            for c in (0, 1):
                total = self.known[c].sum(axis=1, keepdims=True)
                start[c] = (self.known[c] + 0.1) / (total + 0.3)
                self.known[c] = KNOWN_SHARE * counts.sum() * start[c]
        else:
            self.known = 2 * start
        self.p, before = start.copy(), None
        for _ in range(rounds):
            y = self.posteriors(patterns) * counts
            if before is not None and np.abs(y - before).max(initial=0) < 1e-6 * max(counts.sum(), 1):
                break
            before = y
            self.prior = float((y.sum() + 0.5) / (counts.sum() + 10))
            for c, w in ((0, counts - y), (1, y)):
                seen = np.einsum("i,imv->mv", w, onehot) + self.known[c] + 0.05
                self.p[c] = seen / seen.sum(axis=1, keepdims=True)
        self.posterior = {tuple(int(v) for v in r): float(x) for r, x in zip(patterns, self.posteriors(patterns), strict=True)}

    @staticmethod
    def _onehot(patterns: np.ndarray) -> np.ndarray:
        return np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of the defect for each pattern."""
        if not len(patterns):
            return np.zeros(0)
        onehot = self._onehot(patterns)
        a, b = (np.einsum("imv,mv->i", onehot, np.log(self.p[c])) for c in (0, 1))
        z = np.clip(b - a + math.log(self.prior / (1 - self.prior)), -500, 500)
        return 1 / (1 + np.exp(-z))


def best_cutoff(posterior: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cutoff with the best F1 on labelled pairs; of a range of equally good ones the middle."""
    grid = np.linspace(0.05, 0.95, 19)
    f1 = []
    for c in grid:
        chosen = posterior >= c
        hits = (weights * labels)[chosen].sum()
        f1.append(2 * hits / max(weights[chosen].sum() + (weights * labels).sum(), 1e-9))
    good = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(grid[good[len(good) // 2]])


def plant(rows: list[tuple[str, str, str]], lm: LanguageModel) -> list[tuple[str, str, str, str | None]]:
    """(key, question, answer, defect) made of sound (key, question, answer): in turn each defect is planted into a pair, or the
    pair stays as it is (None). An answer in another language is one of another pair's; a cut stands amid a word."""
    out = []
    language = {k: "zh" if _is_han(a) else lm.language(a) for k, _, a in rows}
    long = [(k, a) for k, _, a in rows if len(lm.words(a)) >= 5 or len(_HAN.findall(a)) >= 8]
    for i, (k, q, a) in enumerate(rows):
        kind = (*DEFECTS, None, None, None)[i % 8]
        made: str | None = a
        if kind == "empty":
            made = PLANTED_EMPTY[i // 8 % len(PLANTED_EMPTY)]
        elif kind == "refusal":
            made = PLANTED_REFUSALS[i // 8 % len(PLANTED_REFUSALS)]
        elif kind == "copies_question":
            made = PLANTED_FRAMES[i // 8 % len(PLANTED_FRAMES)].format(q, q.lower(), q.rstrip("?？ "), regex.sub(r"[-'’]", "", q), q[: len(q) // 2 - 1] + q[len(q) // 2 :])
        elif kind == "other_language":
            asked = "zh" if _is_han(q) else lm.language(q)
            others = [x for x, t in zip((long[(i * 7 + j) % len(long)] for j in range(min(40, len(long)))), range(40), strict=False) if language[x[0]] != asked] if long else []
            made = others[0][1] if others and not _ASKS_WORDS.search(q) else None
        elif kind == "truncated":
            words = len(_WORD.findall(a)) if not _HAN.search(a) else len(_HAN.findall(a))
            cut = a[: int(len(a) * (0.45 + 0.4 * (i // 8 % 7) / 7))].rstrip()
            made = cut if words >= 9 and not _END.search(cut) else None
        if made is not None:
            out.append((k, q, made, kind))
    return out


def label_pairs(pairs: DataFrame, docs: DataFrame, key: str = "id", question: str = "question", answer: str = "predicted_answer") -> DataFrame:
    """key, labels array<struct<defect, posterior>>: every pair with the defects it has, the most certain first.

    Each row is a pair of its own, with a null or repeated key too; null questions and answers are read as empty text,
    very long ones are read whole. docs: doc_id, text, lang, for the language model. Other columns are ignored; an empty
    table gives no rows. Equal pairs get equal labels.
    """
    lm = fit_language(docs)
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(lm)
    key_type = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            votes = [_votes(q, a, shared.value) for q, a in zip(b.column("q").to_pylist(), b.column("a").to_pylist(), strict=True)]
            cols = [pa.array([v[d] for v in votes], pa.list_(pa.int8())) for d in DEFECTS]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("q"), b.column("a"), *cols], ["k", "q", "a", *DEFECTS])

    narrow = pairs.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"))
    voted = stage(spread(narrow).mapInArrow(run, f"k {key_type}, q string, a string, " + ", ".join(f"{d} array<tinyint>" for d in DEFECTS)), "votes")
    models, cutoffs = _models(voted, shared)
    hits = []
    for d in DEFECTS:
        every = np.array(list(product((-1, 0, 1), repeat=FUNCTIONS[d])), int)
        hits += [(d, list(map(int, v)), float(p)) for v, p in zip(every, models[d].posteriors(every), strict=True) if p >= cutoffs[d]]
    labelled = voted.select("k", *DEFECTS)
    for d in DEFECTS:  # at most 3 ** functions rows a defect
        own = spark.createDataFrame([(v, p) for e, v, p in hits if e == d], f"{d} array<tinyint>, posterior_{d} double")
        labelled = labelled.join(F.broadcast(own), d, "left")
    found = F.array_compact(F.array(*[F.when(F.col(f"posterior_{d}").isNotNull(), F.struct(F.col(f"posterior_{d}").alias("posterior"), F.lit(d).alias("defect"))) for d in DEFECTS]))
    labels = labelled.select(F.col("k").alias(key), F.reverse(F.array_sort(found)).alias("l")).where(F.size("l") > 0)
    return labels.select(key, F.transform("l", lambda x: F.struct(x["defect"].alias("defect"), x["posterior"].alias("posterior"))).alias("labels"))


def _planted(voted: DataFrame, shared: Broadcast) -> DataFrame:
    """defect, v (votes), label, held, n: how many pairs of each kind `plant` makes of all calm ones have these votes; label 1
    with the defect, 0 without any (pairs with another one may have this too, so they tell nothing); held: for the cutoffs."""
    calm = F.lit(True)
    for d, (leading, votes) in SUSPECT.items():
        calm = calm & (F.size(F.filter(F.slice(d, 1, leading), lambda v: v == 1)) < votes)
    rows = voted.where(calm & F.col("q").isNotNull() & F.col("a").isNotNull()).select("k", "q", "a")
    groups = max(math.ceil(rows.count() / PLANTED_ROWS), 1)
    rows = rows.select("q", "a", F.xxhash64("q", "a").alias("h"), F.pmod(F.xxhash64("k", "q", "a"), F.lit(groups)).alias("group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "q", "a"])
        out: Counter = Counter()
        for k, q, a, kind in plant([(str(i), q, a) for i, (q, a) in enumerate(zip(pdf.q, pdf.a, strict=True))], shared.value):
            votes, held = _votes(q, a, shared.value), xxhash.xxh64_intdigest(k) % 2 == 1
            for d in DEFECTS if kind is None else [kind]:
                out[d, tuple(votes[d]), int(kind == d), held] += 1
        return pd.DataFrame([(*key, n) for key, n in out.items()], columns=["defect", "v", "label", "held", "n"])

    made = rows.groupBy("group").applyInPandas(run, "defect string, v array<int>, label int, held boolean, n bigint")
    return made.groupBy("defect", "v", "label", "held").agg(F.sum("n").alias("n"))


def _models(voted: DataFrame, shared: Broadcast) -> tuple[dict[str, LabelModel], dict[str, float]]:
    """The label model and the cutoff of each defect, from the counts of vote patterns and from planted pairs."""
    planted = sorted((r.defect, tuple(r.v), r.label, r.held, r.n) for r in _planted(voted, shared).collect())  # at most 4 * 3 ** functions rows a defect
    models, cutoffs = {}, {}
    for d in DEFECTS:
        rows = voted.groupBy(F.col(d).alias("v")).count().collect()  # at most 3 ** functions rows
        patterns = np.array([r["v"] for r in rows], int).reshape(len(rows), FUNCTIONS[d])
        known = [(v, label, float(n)) for e, v, label, held, n in planted if e == d and not held]
        if {label for _, label, _ in known} != {0, 1}:
            known = []
        models[d] = LabelModel(patterns, np.array([r["count"] for r in rows], float), known)
        held = [(v, label, n) for e, v, label, held, n in planted if e == d and held]
        labels, n = (np.array([x[i] for x in held], float) for i in (1, 2))
        cutoffs[d] = 0.5
        if labels.any():
            post = models[d].posteriors(np.array([v for v, _, _ in held], int))
            # planted defects are more frequent than real ones are: sound pairs weigh as much more
            share = models[d].prior / (1 - models[d].prior) * n[labels == 0].sum() / n[labels == 1].sum()
            cutoffs[d] = best_cutoff(post, labels, n * np.where(labels == 1, share, 1.0))
    return models, cutoffs


def main_defect(labels: DataFrame, key: str = "id") -> DataFrame:
    """key, defect: of several labels the one that explains the others. An empty, declined or copied answer is neither
    cut off nor in a language of its own; between these two the more certain counts."""
    names = F.transform("labels", lambda x: x["defect"])
    pick = F.coalesce(*[F.when(F.array_contains(names, d), F.lit(d)) for d in DEFECTS[:3]], names[0])
    return labels.select(key, pick.alias("defect"))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of each defective pair of qa_results, with posteriors: id, defect, posterior."""
    qa = latest(table(spark, sf_dir, "qa_results").select("id", "question", "predicted_answer", "ingested_at"), ["id"])
    return label_pairs(qa, table(spark, sf_dir, "documents")).select("id", F.explode("labels").alias("l")).select("id", "l.defect", F.round("l.posterior", 6).alias("posterior"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of qa_results with their type of defect."""
    qa = latest(table(spark, sf_dir, "qa_results").select("id", "question", "predicted_answer", "ingested_at"), ["id"])
    return main_defect(label_pairs(qa, table(spark, sf_dir, "documents")))


QUERIES = {"p2_found": p2_found, "p2_labels": p2_labels}
SQL: dict[str, str] = {}
