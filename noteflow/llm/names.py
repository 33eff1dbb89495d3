"""Problem 3: spellings of the same person or organisation.

Names with the same words in any order are one spelling to begin with (titles and small words aside). Each is read into
parts: a core (the surname, or the place of an organisation), the given name or the kind of organisation, further words,
initials and numbers. Which words are given names and which are heads of organisations is learned from the names, beside
short lists of the usual ones. Cores are joined with each other within a bounded edit distance by tries: cores are sharded
by their segments (of 2 d + 1 segments one stays whole, as each of d edits spoils two at most), each shard's cores make a
trie, and a Levenshtein automaton per core walks it. A core then belongs to the most frequent spelling near it, unless
names of several people establish it as one of its own; no core leads on to another. Names with the same core are the
same entity if their other parts agree: abbreviations, nicknames and initials are resolved among the entities of that
core, and where several fit, by the alias entries in which the name stands. Names that could not be read so are joined
as a whole: tries of whole names, walked with every order of their words.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteflow.functions.runtime import parallelism, spread, stage, table

#: Cores that query one shard in one task, at most about.
SHARD_QUERIES = 5000
#: A word is a given name if it stands in that place beside so many different surnames, and a head of organisations if so
#: many different words follow its `of`; a core with so many different given names is established.
LEARN, ESTABLISHED = 3, 3
#: A learned given name that shortens or misspells one so many times as frequent is no name of its own.
VARIANT = 5
#: Words that are learned, at most (the most frequent ones).
LEARNED_WORDS = 50_000
#: Names of up to so many words are looked up in every order, longer ones in every rotation and with any two words anywhere.
ORDERED_WORDS = 4
#: Letters of the shortest word that may be a misspelling (`reach` of it or of a word with a letter more).
MISSPELT = 4

# Given names and what people call their bearers. The part before the colon is the full name.
NICKNAMES = """
alexander: alec alex xander sandy sasha al lex; augustine: gus august austin; benjamin: ben benny benji; christopher: chris kit topher;
cordelia: cora delia cordy; dorothy: dot dolly dora dottie dodie; edmund: ned ed eddie ted; elizabeth: liz betty elsie beth eliza lizzie bess bessie libby lisa;
fiammetta: fia; frederick: fred fritz freddie freddy rick; gabrielle: gabi elle gaby gabby; gwendolen: gwen wendy; henrietta: etta hettie hetty harriet;
hortensia: tensia; ingrid: inga; jonathan: jon jonty jonny johnny nathan; josephine: jo josie jojo; katherine: kate kitty kathy katie kath kit;
leopold: leo poldi; margaret: maggie peggy greta meg marge margie daisy madge rita; nicholas: nick niko nicky klaus; philippa: pippa pip;
quentin: quen; robert: rob bob bobby robbie bert; rosalind: roz linda rosa lindy; susannah: sue sanna susie susan suzy; theodore: ted theo teddy;
victoria: vicky tori vic; wilhelmina: willa mina minnie billie; william: bill will billy willy liam; zachary: zach zak zack;
andrew: andy drew; anthony: tony; charles: charlie chuck; daniel: dan danny; david: dave davy; edward: ed eddie ned ted; eleanor: ellie nell nora;
george: georgie; gregory: greg; helen: nell; james: jim jimmy jamie; jennifer: jen jenny; john: jack johnny; joseph: joe joey; lawrence: larry;
matthew: matt; michael: mike mick mickey; patricia: pat patty trish; patrick: pat paddy; peter: pete; rebecca: becky becca; richard: rick dick richie;
ronald: ron ronnie; samuel: sam sammy; stephen: steve; thomas: tom tommy; timothy: tim; vincent: vince; walter: walt wally; abigail: abby gail;
barbara: barb babs; catherine: cathy kate kitty; deborah: deb debbie; mary: molly polly; sarah: sally; anne: annie nancy; martha: patty
"""
# Abbreviations in the names of organisations.
EXPANSIONS = dict(
    x.split("=")
    for x in (
        "gdn=garden gdns=garden gardens=garden bot=botanical botanic=botanical botanicals=botanical natl=national nat=national mus=museum univ=university uni=university"
        " intl=international int=international apt=airport arpt=airport assn=association assoc=association ass=association shpg=shipping shipg=shipping co=company"
        " ltd=limited dept=department dep=department dpt=department sch=school bk=bank bnk=bank soc=society roy=royal inst=institute instit=institute sns=sons"
        " bros=brothers 1st=first 2nd=second 3rd=third mar=maritime fish=fisheries fdn=foundation coll=college lib=library hosp=hospital geol=geological"
        " i=first"
    ).split()
    if x != "i=first"
)
# Words that make a name one of an organisation, and words without weight in it.
ORG_WORDS = set(
    "garden botanical national museum university international airport association chess shipping department fisheries school bank society royal institute"
    " maritime sons daughters brothers first second third college trust harbour rowing foundation press almanac geological survey club library hospital theatre"
    " company limited ministry office agency council union church academy orchestra railway corporation group partners works mill".split()
)
ORG_HEADS = ORG_WORDS - {"first", "second", "third", "royal", "national", "international"}
ORG_EMPTY = set("of the and messrs org company limited no number for in at a incorporated inc plc gmbh de la".split())
TITLES = set("dr prof professor mr mrs ms miss mx sir dame lady lord rev reverend hon capt captain col gen phd md jr sr esq emer emeritus junior senior".split())
PARTICLES = set("von van de la der den del di da du le al el bin ibn zu zur ten ter of the".split())

GIVEN: dict[str, set[str]] = {}
for _line in NICKNAMES.replace("\n", " ").split(";"):
    _full, _, _short = _line.partition(":")
    GIVEN.setdefault(_full.strip(), set()).add(_full.strip())
    for _n in _short.split():
        GIVEN.setdefault(_n, set()).add(_full.strip())
FULL = {f for v in GIVEN.values() for f in v}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"})
_DIGITS = str.maketrans("01358", "olesb")


def fold(name: str) -> str:
    """Lower case without marks, odd spaces and invisible characters."""
    s = unicodedata.normalize("NFKC", name).casefold().translate(_LETTERS)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return regex.sub(r"\s+", " ", s.replace("’", "'").replace("`", "'")).strip()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    old, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            v = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                v = min(v, old[j - 1] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        old, row = row, new
    return min(row[-1], most + 1)


def reach(token: str) -> int:
    """The edit distance at which a core still counts as misspelt."""
    return 0 if len(token) < 5 else 1 if len(token) < 8 else 2


def _letters(token: str) -> str:
    """A token with digits that stand for letters replaced, and rn as m (they look alike)."""
    if any(c.isdigit() for c in token) and sum(c.isalpha() for c in token) >= 2 * sum(c.isdigit() for c in token):
        token = token.translate(_DIGITS)
    return token.replace("rn", "m")


@lru_cache(4)
def _plain(name: str) -> str:
    """The folded name without a note on its kind, elisions joined and genitives cut."""
    s = regex.sub(r"\((?:org|ngo|company|person)\.?\)", " ", fold(name))
    s = s.replace("int'l", "intl").replace("nat'l", "natl")
    s = regex.sub(r"\b([od])'(?=\w{3})", r"\1", s)
    return regex.sub(r"(?<=\w{3})'s?\b", "", s)


_ACRONYM = regex.compile(r"\b\p{Lu}\p{L}{0,2}\p{Lu}\b")
_TOKEN = regex.compile(r"[^\W_]+(?:-+[^\W_]+)*")


def bag(name: str) -> str:
    """The words of a name in order of the alphabet, without titles and small words: the same for every order of them."""
    words = [w for w in _TOKEN.findall(_plain(name)) if w not in TITLES and w not in ("of", "the", "and")]
    return " ".join(sorted(words))


def roles(name: str) -> list[tuple[str, str, str]]:
    """(role, word, beside) that a name tells: of two words (titles and particles aside) that are no organisation's, the given
    name and the surname, by a comma or their order; of `X of Y` the head X and Y."""
    s = _plain(name)
    if m := regex.fullmatch(r"(?:.* )?([^\W\d_]{4,}) of ([^\W\d_]{3,}).*", s):
        return [("head", m.group(1), m.group(2))]
    front, comma, back = s.partition(",")
    words = [w for w in _TOKEN.findall(s) if w not in TITLES and w not in PARTICLES and len(w) > 1]
    if len(words) != 2 or any(w in ORG_WORDS or w in EXPANSIONS or not w.replace("-", "").isalpha() for w in words):
        return []
    short = {fold(c) for c in _ACRONYM.findall(unicodedata.normalize("NFKC", name))} if not name.isupper() else set()
    dotted = set(regex.findall(r"([^\W_]+)\.", s))
    if short & set(words) or dotted & set(words):
        return []
    given, surname = reversed(words) if comma and _TOKEN.findall(front) and _TOKEN.findall(back) else words
    return [("given", given, surname)]


def parse(name: str, known: Known | None = None) -> dict:
    """kind (org, person or other), core, type (of an organisation, or the further words of a person), given (full names it may
    stand for), initial, short (a given name that is not known). Order, case, marks, titles, particles and punctuation do
    not matter."""
    known = known or Known()
    none = {"kind": "other", "core": "", "type": "", "given": [], "initial": "", "short": ""}
    s = _plain(name)
    raw = _TOKEN.findall(s)
    words = [_expand(w) for w in raw]
    heads = [w for w in words if w in known.heads or (len(w) >= 7 and w not in known.given and known.head_near(w))]
    if heads:
        return _organisation(words, known) or none
    caps = _ACRONYM.findall(unicodedata.normalize("NFKC", name))
    acronym = [fold(c) for c in caps if fold(c) in raw and fold(c) not in known.given and fold(c) not in PARTICLES and len(fold(c)) <= 3]
    rest = [w for w in words if w not in ORG_EMPTY and w not in acronym]
    if len(acronym) == 1 and len(rest) == 1 and len(rest[0]) >= 5 and rest[0] not in known.given and not name.isupper():
        return none | {"kind": "org", "core": _letters(rest[0].replace("-", "")), "short": "".join(sorted(acronym[0]))}
    return _person(s, name, known) or none


def _expand(word: str) -> str:
    return EXPANSIONS.get(word, word)


def _organisation(words: list[str], known: Known) -> dict | None:
    types, cores = [], []
    for w in words:
        if w in ORG_EMPTY:
            continue
        if w in known.org_words or w.isdigit():
            types.append(w)
        elif n := known.head_near(w):
            if n not in ORG_EMPTY:
                types.append(n)
        else:
            cores.append(w)
    if not cores or not types and not words:
        return None
    core = max(cores, key=len)
    acronym = [c for c in cores if c != core and len(c) <= 3]
    if not types and acronym:
        return {"kind": "org", "core": _letters(core.replace("-", "")), "type": "", "given": [], "initial": "", "short": "".join(sorted(acronym[0]))}
    if not types:
        return None
    # other unknown words are kept: Harbour Trust of A and B is not one of A
    more = sorted(_letters(c) for c in cores if c != core and len(c) > 3)
    return {"kind": "org", "core": _letters(core.replace("-", "")), "type": " ".join(sorted(set(types)) + more), "given": [], "initial": "", "short": ""}


def _person(s: str, name: str, known: Known) -> dict | None:
    nick = [w for q in regex.findall(r"[\"“”(\[]([^\"“”()\[\]]+)[\"“”)\]]", s) for w in regex.findall(r"[^\W_]+", q)]
    s = regex.sub(r"[\"“”(\[][^\"“”()\[\]]+[\"“”)\]]", " ", s)
    dotted = set(regex.findall(r"([^\W_]{3,})\.(?=\s|$)", s.rstrip(" .")))
    front, comma, back = s.partition(",")

    def parts(text: str) -> list[str]:
        return [w for w in _TOKEN.findall(text) if w not in TITLES and w not in PARTICLES]

    def given_like(w: str) -> bool:
        return w in known.given or w in dotted or bool(known.full_near(_letters(w)))

    left, right = [w.removeprefix("al-").removeprefix("el-") for w in parts(front)], parts(back)
    if comma and left and right and not (len(left) > 1 and any(w in TITLES for w in right)):
        order, core = right, max(left, key=len)
        order = order + [w for w in left if w != core]
    else:
        every = left + right
        long = [w for w in every if len(w) > 1]
        if len(long) < 1 or len(every) < 2:
            return None
        upper = {fold(w) for w in regex.findall(r"\b\p{Lu}[\p{Lu}\-']{2,}\b", unicodedata.normalize("NFKC", name))}
        unknown = [w for w in long if w not in known.given]
        plain = [w for w in unknown if not given_like(w)] or unknown or long
        shouted = [w for w in plain if w in upper]
        core = shouted[0] if len(shouted) == 1 and len(plain) > 1 else plain[-1]
        order = [w for w in every if w != core]
    core = _letters(core.replace("-", ""))
    if len(core) < 2:
        return None
    given: set[str] = set()
    initial = short = ""
    more = []
    for w in order:
        if len(w) == 1:
            initial = initial or w
        elif w in known.given:
            given = given & known.given[w] if given & known.given[w] else given or set(known.given[w])
        elif not given and not short:
            prefix = known.beginning(w) if w in dotted or len(w) <= 5 else set()
            if prefix:
                given = prefix
            elif near := (known.full_near(_letters(w)) or known.full_near(w)):
                given = {near}
            else:
                short = w
        elif len(w) > 2 and not known.full_near(_letters(w)) and not (len(w) < 6 and any(edits(w, p, 1) <= 1 for p in PARTICLES if len(p) > 2)):
            more.append(_letters(w.replace("-", "")))  # another name that must agree: Robert Smith Jones is not Robert Jones
    for w in nick:
        if w in known.given and not short:
            given = given & known.given[w] if given & known.given[w] else given or set(known.given[w])
    if not given and not short and not initial:
        return None
    return {"kind": "person", "core": core, "type": " ".join(sorted(more)), "given": sorted(given), "initial": "" if given or short else initial, "short": short}


class Trie:
    """Words by their letters; `near` walks it with a Levenshtein automaton (transpositions count once)."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[str]:
        """Words of the trie within `most` edits. A state is the row of distances to all prefixes of `word`; branches
        whose row has nothing within `most` are not entered."""
        found: list[str] = []
        first = list(range(len(word) + 1))
        stack = [(n, c, first, None, "") for c, n in self.root.items() if c]
        if "" in self.root and first[-1] <= most:
            found.append(self.root[""])
        while stack:
            node, c, row, before, last = stack.pop()
            new = [row[0] + 1]
            for j, y in enumerate(word):
                v = min(row[j] + (c != y), row[j + 1] + 1, new[j] + 1)
                if before is not None and j and c == word[j - 1] and last == y:
                    v = min(v, before[j - 1] + 1)
                new.append(v)
            if min(new) > most and (before is None or min(row) > most):
                continue
            for d, n in node.items():
                if d:
                    stack.append((n, d, new, row, c))
                elif new[-1] <= most:
                    found.append(n)
        return found


class Known:
    """Given names with the full names that they may stand for, full given names, and heads of organisations: the usual ones
    and those learned."""

    def __init__(self, given: dict[str, int] | None = None, heads: list[str] = ()):
        """given: learned given names with the number of surnames beside them."""
        given = given or {}
        self.given = GIVEN | {g: {g} for g in self._names_of_their_own(given) if g not in GIVEN and g not in ORG_WORDS}
        self.full = sorted(FULL | (set(self.given) - set(GIVEN)))
        self.heads = ORG_HEADS | (set(heads) - set(self.given))
        self.org_words = ORG_WORDS | self.heads
        self._tries = {False: self._trie(self.full, 4), True: self._trie(sorted(self.heads), 7)}
        self._found: dict[tuple[str, bool], str | None] = {}

    @staticmethod
    def _trie(words: list[str], least: int) -> tuple[Trie, dict[int, np.ndarray]]:
        """Words of `least` letters and more as a trie, and their letters by length."""
        masks: dict[int, list[int]] = {}
        for w in words:
            if len(w) >= least:
                masks.setdefault(len(w), []).append(_mask(w))
        return Trie(w for w in words if len(w) >= least), {n: np.array(m, np.uint64) for n, m in masks.items()}

    @staticmethod
    def _names_of_their_own(given: dict[str, int]) -> list[str]:
        """Neither short forms nor misspellings of names that are VARIANT times as frequent."""
        trie = Trie(given)
        ordered = sorted(given)

        def own(w: str) -> bool:
            near = {_letters(w), *trie.near(w, 1 if len(w) < 7 else 2), *trie.near(_letters(w), 1)}
            longer = ordered[bisect_left(ordered, w) : bisect_left(ordered, w + "\U0010ffff")] if len(w) <= 5 else []
            return all(given.get(v, 0) < VARIANT * given[w] for v in (*near, *longer) if v != w)

        return [w for w in ordered if own(w)]

    def beginning(self, word: str) -> set[str]:
        """The full given names that begin with a word."""
        return set(self.full[bisect_left(self.full, word) : bisect_left(self.full, word + "\U0010ffff")])

    def _nearest(self, word: str, heads: bool, least: int, most: int) -> str | None:
        if len(word) < least:
            return None
        if (word, heads) not in self._found:
            trie, masks = self._tries[heads]
            own = np.uint64(_mask(word))
            alive = any((np.bitwise_count(masks[n] ^ own) <= 2 * most).any() for n in range(len(word) - most, len(word) + most + 1) if n in masks)
            near = trie.near(word, most) if alive else []
            best = min(((edits(word, v, most), v) for v in near), default=(9, ""))
            self._found[word, heads] = best[1] if best[0] <= min(most, 1 if len(word) < 7 else 2) else None
        return self._found[word, heads]

    def full_near(self, word: str) -> str | None:
        """The full given name that a word misspells."""
        return self._nearest(word, False, 4, 2)

    def head_near(self, word: str) -> str | None:
        """The head of organisations that a word misspells."""
        return self._nearest(word, True, 7, 1)


def _mask(word: str) -> int:
    """The set of a word's letters as bits (letters 64 apart share one). An edit changes at most two of them."""
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 63)
    return m


def _segments(word: str, n: int) -> list[tuple[int, str]]:
    """(start, text) of n segments of nearly equal length."""
    cuts = [len(word) * i // n for i in range(n + 1)]
    return [(a, word[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _shard_keys(word: str, shorter: bool = True) -> tuple[list[str], list[str]]:
    """Keys under which a word is kept, and keys that it asks: a kept word of length m within reach shares a segment at
    nearly the same place. Shorter words are only asked for with `shorter`."""

    def most(m: int) -> int:
        """The largest distance at which a word of length m has to be found."""
        return reach("x" * (m + 2)) if m > 2 else 0

    n = len(word)
    kept = [f"{n}|{i}|{t}" for i, (_, t) in enumerate(_segments(word, 2 * most(n) + 1))] if most(n) else []
    asked = set()
    for m in range(n - 2 if shorter else n, n + 3):
        e = max(reach(word), reach("x" * m))
        if not e or abs(m - n) > e or not most(m):
            continue
        for i, (a, t) in enumerate(_segments("x" * m, 2 * most(m) + 1)):
            # a whole segment that stands `shift` further has |shift| edits before it and |n - m - shift| behind it
            for shift in range(-e, e + 1):
                if abs(shift) + abs(n - m - shift) <= e and 0 <= a + shift <= n - len(t):
                    asked.add(f"{m}|{i}|{word[a + shift : a + shift + len(t)]}")
    return kept, sorted(asked)


def trie_join(words: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """a, b: all pairs of different words within `reach` of each other, a of `words`, b of `kept` (of `words` too unless given).
    Both: w, distinct and not null; an empty table gives no rows."""

    shorter = kept is not None

    def keys(sides):
        def run(batches):
            for b in batches:
                out = [(w, k, side) for w in b.column("w").to_pylist() for side, ks in enumerate(_shard_keys(w, shorter)) for k in ks if side in sides]
                w, k, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.string()), pa.array(s, pa.int32())], ["w", "key", "side"])

        return run

    schema = "w string, key string, side int"
    keyed = spread(words.select("w")).mapInArrow(keys((1,) if kept is not None else (0, 1)), schema)
    if kept is not None:
        keyed = keyed.unionByName(spread(kept.select("w")).mapInArrow(keys((0,)), schema))
    keyed = stage(keyed, "shard-keys")
    held, asked = keyed.where("side = 0").select("w", "key"), keyed.where("side = 1").select("w", "key")
    used = asked.join(held.select("key").distinct(), "key", "left_semi")
    # keys that many words ask are split, and their trie is repeated
    salts = used.groupBy("key").agg(F.ceil(F.count("w") / SHARD_QUERIES).cast("int").alias("salts"))
    n = 4 * parallelism(words.sparkSession)
    place = F.pmod(F.xxhash64("key", "salt"), F.lit(4 * n)).cast("int")
    ask = used.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("w"), F.col("salts")).cast("int")).select("w", "key", "salt", F.lit(1).alias("side"))
    keep = held.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("w", "key", "salt", F.lit(0).alias("side"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = set()
        for (key, _), group in pdf.groupby(["key", "salt"], sort=False):
            held = list(group.w[group.side == 0])
            trie, masks = Trie(held), {_mask(v) for v in held}
            length = "x" * int(key.split("|", 1)[0])  # all words of the trie are so long
            for w in group.w[group.side == 1]:
                most, own = max(reach(w), reach(length)), _mask(w)
                if any((own ^ m).bit_count() <= 2 * most for m in masks):  # else no word has nearly the same letters
                    pairs.update((w, v) for v in trie.near(w, most) if v != w)
        return pd.DataFrame(sorted(pairs), columns=["a", "b"], dtype=object)

    both = ask.unionByName(keep).withColumn("place", place).repartition(n, "place")
    found = both.groupBy("place").applyInPandas(run, "a string, b string")
    if not shorter:  # each pair was asked by its shorter word
        found = found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    return found.distinct()


def _roots(cores: DataFrame) -> DataFrame:
    """core, root: the most frequent spelling near a core that itself has no better one (ties by spelling). A core with
    ESTABLISHED different given names is a spelling of its own. cores: core, n (spellings), rests (different given names).

    In a round, cores without a better one among those left are roots, and those near a root go to it; cores whose better
    ones all went elsewhere wait for the next round. So no cluster is wider than the reach around its root."""
    near = trie_join(cores.select(F.col("core").alias("w")))
    own = lambda c: cores.select(F.col("core").alias(c), F.struct(F.col("n").alias("n"), F.col("rests").alias("rests")).alias(f"of_{c}"))
    better = (F.col("of_b.n") > F.col("of_a.n")) | ((F.col("of_b.n") == F.col("of_a.n")) & (F.col("b") < F.col("a")))
    pairs = near.join(own("a"), "a").join(own("b"), "b").where((F.col("of_a.rests") < ESTABLISHED) & better)
    pairs = stage(pairs.select("a", "b", F.col("of_b.n").alias("n")), "better-cores")
    left = stage(cores.select("core"), "cores-left")
    done = None
    while not left.isEmpty():
        asks = pairs.join(left.select(F.col("core").alias("b")), "b", "left_semi")
        roots = stage(left.join(asks.select(F.col("a").alias("core")).distinct(), "core", "left_anti"), "core-roots")
        best = F.min_by("b", F.struct(-F.col("n"), F.col("b")))
        led = asks.join(roots.select(F.col("core").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("core")).agg(best.alias("root"))
        led = stage(led.join(left, "core", "left_semi"), "cores-led")
        part = roots.select("core", F.col("core").alias("root")).unionByName(led)
        done = part if done is None else done.unionByName(part)
        left = stage(left.join(part.select("core"), "core", "left_anti"), "cores-left")
    return done if done is not None else cores.select("core", F.col("core").alias("root"))


def learn(names: DataFrame) -> Known:
    """The given names and heads of organisations that the names themselves tell (`roles`): words with LEARN different words
    beside them in that role, given names also at least twice as many as they have as surnames. At most LEARNED_WORDS of
    each are taken to the driver. names: name, distinct."""

    told = stage(names.select(F.explode("roles").alias("r")).select("r.*").distinct(), "name-roles")
    found = told.groupBy("role", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEARN)
    as_surname = told.where("role = 'given'").groupBy(F.col("beside").alias("word")).agg(F.count(F.lit(1)).alias("s"))
    given = found.where("role = 'given'").join(as_surname, "word", "left").where(F.col("n") >= 2 * F.coalesce("s", F.lit(0)))
    most = lambda df: {r.word: r.n for r in df.orderBy(F.desc("n"), "word").limit(LEARNED_WORDS).select("word", "n").collect()}
    return Known(most(given), list(most(found.where("role = 'head'"))))


def whole_matches(open_: DataFrame, forms: DataFrame) -> DataFrame:
    """form, other: forms (words of a name in alphabetical order) of `open_` with the forms within the reach of the whole name
    in some order of the words, word by word within the reach of each. Both: form, distinct."""

    def orders(form: str) -> set[str]:
        words = form.split(" ")
        if len(words) <= ORDERED_WORDS:
            return {" ".join(p) for p in permutations(words)}
        # words in alphabetical order keep it but for the misspelt ones, of which the reach of a whole name allows two
        out = {" ".join(words[i:] + words[:i]) for i in range(len(words))}
        long = [i for i, w in enumerate(words) if len(w) >= MISSPELT]
        for some in combinations(long if len(long) > 1 else range(len(words)), 2):
            rest = [w for i, w in enumerate(words) if i not in some]
            for a in range(len(rest) + 1):
                one = [*rest[:a], words[some[0]], *rest[a:]]
                out.update(" ".join([*one[:b], words[some[1]], *one[b:]]) for b in range(len(one) + 1))
        return out

    def ask(batches):
        for b in batches:
            rows = [(f, o) for f in b.column("form").to_pylist() for o in orders(f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["form", "w"])

    asked = stage(spread(open_.select("form")).mapInArrow(ask, "form string, w string"), "name-orders")
    pairs = trie_join(asked.select("w").distinct(), forms.select(F.col("form").alias("w")))

    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            return len(x.split(" ")) == len(y.split(" ")) and all(edits(p, q, 2) <= max(reach(p), reach(q)) for p, q in zip(x.split(" "), y.split(" "), strict=True))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    good = pairs.where(F.pandas_udf(agree, "boolean")("a", "b"))
    return asked.join(good, F.col("w") == F.col("a")).where("form != b").select("form", F.col("b").alias("other")).distinct()


def _only(rows: DataFrame) -> DataFrame:
    """name, entity of the names for which exactly one entity fits."""
    return rows.groupBy("name").agg(F.min("entity").alias("entity"), F.max("entity").alias("most")).where("entity = most").select("name", "entity")


def link_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """name, entity: the names that could be told to mean a person or organisation; equal entities mean the same one.

    names: name, any number of rows (nulls and blanks are no names). entries: entry, name, rows that say that all names
    of an entry mean the same. Names that fit several entities and no entry decides, and names of other things, do not
    come out. An empty table gives no rows; other columns are ignored.
    """
    distinct = names.where(F.length(F.trim("name")) > 0).select("name").distinct()

    def spell(batches):
        for b in batches:
            names_ = b.column("name").to_pylist()
            told = pa.array([[dict(zip(("role", "word", "beside"), r, strict=True)) for r in roles(n)] for n in names_], pa.list_(pa.struct([(k, pa.string()) for k in ("role", "word", "beside")])))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([bag(n) for n in names_], pa.string()), told], ["name", "form", "roles"])

    spelt = stage(spread(distinct).mapInArrow(spell, "name string, form string, roles array<struct<role: string, word: string, beside: string>>"), "spellings")
    shared = names.sparkSession.sparkContext.broadcast(learn(spelt))

    def read(batches):
        known = shared.value
        for b in batches:
            got = [parse(n, known) for n in b.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("name"), b.column("n"), *[pa.array([g[k] for g in got], pa.list_(pa.string()) if k == "given" else pa.string()) for k in ("kind", "core", "type", "given", "initial", "short")]],
                ["name", "n", "kind", "core", "type", "given", "initial", "short"],
            )

    # names of the same words are read once, preferably with a comma, which tells the surname
    first = spelt.where("form != ''").groupBy("form").agg(F.min_by("name", F.struct(F.when(F.contains("name", F.lit(",")), 0).otherwise(1), "name")).alias("name"), F.count(F.lit(1)).alias("n"))
    first = stage(first, "forms")
    parsed = stage(
        spread(first.select("name", "n")).mapInArrow(read, "name string, n bigint, kind string, core string, type string, given array<string>, initial string, short string").where("kind != 'other'"),
        "names",
    )
    roots = _roots(stage(parsed.groupBy("core").agg(F.sum("n").alias("n"), F.count_distinct("kind", "given", "short", "initial", "type").alias("rests")), "cores"))
    rows = stage(parsed.join(roots, "core").drop("core", "n"), "rooted-names")

    def entity(*parts):
        return F.concat_ws("|", *parts)

    org = rows.where("kind = 'org' AND type != ''").withColumn("entity", entity(F.lit("o"), "root", "type"))
    more = F.when(F.col("type") != "", F.col("type"))  # the further words of a person's name are part of who it is
    full = rows.where("kind = 'person' AND size(given) = 1").withColumn("entity", entity(F.lit("p"), "root", F.col("given")[0], more))
    sure = org.select("name", "root", "entity", "type", F.lit(None).cast("string").alias("full")).unionByName(
        full.select("name", "root", "entity", F.lit(None).cast("string").alias("type"), F.col("given")[0].alias("full"))
    )
    sure = stage(sure, "sure-names")
    known = stage(sure.select("root", "entity", "type", "full").distinct(), "entities")
    open_ = rows.where("(kind = 'org' AND type = '') OR (kind = 'person' AND size(given) != 1)")
    abbreviated = F.filter(F.split("type", " "), lambda w: ~w.isin("sons", "daughters", "brothers"))
    heads = F.transform(abbreviated, lambda w: F.substring(w, 1, 1))

    def sorted_letters(*more):
        return F.array_join(F.array_sort(F.concat(heads, F.array(*[F.lit(m) for m in more]).cast("array<string>"))), "")

    shorts = F.array(*[sorted_letters(*m) for m in ("", "c", "o", "cl", "l")])
    # what an open name asks for and what an entity answers to are keys of equality joins, so a surname that a third of
    # all names share does not pair all its names with all its entities; only given names that no list has compare
    # with every given name of their core
    none = F.array().cast("array<string>")
    answers = F.concat(
        F.when(F.col("type").isNotNull(), F.transform(F.array_distinct(shorts), lambda x: F.concat(F.lit("a:"), x))).otherwise(none),
        F.when(F.col("full").isNotNull(), F.array(F.concat(F.lit("i:"), F.substring("full", 1, 1)), F.concat(F.lit("g:"), "full"), F.lit("r:"))).otherwise(none),
    )
    asks = (
        F.when(F.col("kind") == "org", F.array(F.concat(F.lit("a:"), "short")))
        .when(F.size("given") > 1, F.transform("given", lambda x: F.concat(F.lit("g:"), x)))
        .when(F.col("initial") != "", F.array(F.concat(F.lit("i:"), "initial"), F.concat(F.lit("a:"), "initial")))
        .when(F.col("short") != "", F.array(F.lit("r:")))
        .otherwise(none)
    )
    targets = known.select("root", "entity", "full", F.explode(answers).alias("key"))
    asked = open_.select("name", "root", "short", F.explode(asks).alias("key"))
    near = (F.col("key") != "r:") | (F.levenshtein("short", F.col("full")) <= 2)
    candidates = stage(asked.join(targets, ["root", "key"]).where(near).select("name", "entity").distinct(), "candidates")
    solved = _only(candidates)
    # several fit: the other names of an alias entry decide
    settled = sure.select("name", "entity").unionByName(solved)
    told = (
        entries.select("entry", "name").distinct().join(candidates.select("name", F.col("entity").alias("may")), "name")
        .join(entries.select("entry", F.col("name").alias("other")).distinct(), "entry").where("name != other")
        .join(settled.select(F.col("name").alias("other"), "entity"), "other").where("entity = may")
        .join(solved, "name", "left_anti").select("name", "entity")
    )
    # given names that no list has, and nicknames and initials of which no full name was found
    lone = open_.where("kind = 'person' AND (short != '' OR size(given) > 1)").join(candidates, "name", "left_anti").select(
        "name", entity(F.lit("p"), "root", F.when(F.col("short") != "", F.col("short")).otherwise(F.array_join("given", "/")), more).alias("entity")
    )
    read_ = stage(first.join(settled.unionByName(_only(told)).unionByName(lone), "name").select("form", "entity"), "read-names")
    # what could not be read is joined as a whole
    open_forms = stage(first.where(F.contains("form", F.lit(" "))).join(parsed.select("name"), "name", "left_anti").select("form"), "open-forms")
    whole = whole_matches(open_forms, first.select("form"))
    taken = whole.join(read_.withColumnRenamed("form", "other"), "other").groupBy("form").agg(F.min("entity").alias("entity"), F.max("entity").alias("most")).where("entity = most").select("form", "entity")
    own = open_forms.join(taken, "form", "left_anti").select("form", entity(F.lit("w"), F.col("form")).alias("entity"))
    return spelt.join(read_.unionByName(taken).unionByName(own), "form").select("name", "entity")


def name_sources(notes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All names of atomic_notes and alias_entries, and the alias entries as entry, name."""
    entries = aliases.select(
        F.col("entry_id").alias("entry"), F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")
    ).where(F.length(F.trim("name")) > 0)
    return notes.select(F.explode("entities").alias("name")).unionByName(entries.select("name")), entries


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, entity of all names of persons and organisations."""
    names, entries = name_sources(table(spark, sf_dir, "atomic_notes"), table(spark, sf_dir, "alias_entries"))
    return link_names(names, entries)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different spellings of the same person or organisation."""
    linked = stage(p3_entities(spark, sf_dir), "linked-names")
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL: dict[str, str] = {}
