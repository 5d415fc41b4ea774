"""Abusive, hateful or sexual content: gradient-boosted trees over dense features, calibrated.

Per document: densities of lexicon words by kind, how often they stand near second-person words, family,
groups and the like, capitals, punctuation, how often a word only reads as abusive once a disguise is
undone, and log-odds of words and word pairs learnt from the ratings. Trees are boosted on rated
documents and decide alone; isotonic regression on held-out folds makes probabilities of their scores.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.seeds import ABUSIVE_SEEDS, CLEAN_SEEDS
from tidemark.llm.text import plain

#: Rated documents the classifier is fitted on at most (a hash order of the ids decides which).
MAX_LABELLED = 20_000
FOLDS = 5
#: Slots of the hashed words and word pairs.
SLOTS = 1 << 16
#: Texts that shrink a word's log-odds, and texts that must hold it.
PRIOR, LEAST_TEXTS = 8.0, 4
#: Words apart within which two kinds count as near; a sentence's end is farther than that.
NEAR = 8

# General word lists by kind in English, German, Spanish and French, without accents.
INSULT = """idiot moron imbecile imbecil cretin scumbag bastard bitch asshole arsehole dumbass jackass dickhead shithead prick cunt twat wanker
parasite pervert loser retard hag tosser douchebag motherfucker halfwit nitwit dimwit blockhead numbskull crackhead lowlife leech sissy weasel creep slob maggot dirtbag
arschloch wichser hurensohn versager vollidiot trottel depp dummkopf drecksau dreckschwein drecksack miststuck spast missgeburt schwachkopf penner arsch sau
gilipollas cabron pendejo idiota hijodeputa capullo subnormal imbecil connard connasse abruti salaud encule batard ordure minable""".split()
DEGRADE = """stupid dumb dumber dumbest braindead brainless worthless useless pathetic gutless spineless filthy disgusting ugly ignorant clown fool coward pig swine rat snake fat lazy retarded
hopeless talentless clueless incompetent laughable joke trash garbage waste oxygen failure embarrassment disgrace dirt scum smelly stinking vile
dumm dumme dummer wertlos erbarmlich hasslich widerlich nichtsnutz estupido estupida tonto inutil basura asqueroso inutile degoutant""".split()
VULGAR = """fuck fucking fucker fucked shit bullshit piss crap ass arse fick ficken scheisse scheiss fresse schnauze verpiss kack
mierda joder puta puto cono culo merde putain foutre gueule chier hell damn""".split()
HARM = """kill killed murder beat burn smash shoot shot stab strangle hurt crush slit hang bleed bloody choke rot die dies dead death cancer drown bullet knife gun punch
bury grave rope noose suicide torture rape rip bridge cliff truck acid poison skin gas lynch whip funeral coffin
umbringen schlagen zusammenschlagen abstechen erschiessen fertig tot sterben stirb verrecken verrecke totschlagen matar matare mato golpear muere morir muerto tuer tuerai frapper casserai creve crever mourir mort cancer""".split()
BODY = """teeth tooth fingers finger bones bone throat face head neck skull legs arms mouth jaw nose knees zahne knochen hals kopf dientes huesos cuello cara dents gorge tete visage boots""".split()
FAMILY = "mother mom mum father family daughter son wife husband sister kids mutter familie tochter frau kinder madre familia hija mere famille fille".split()
WISH = "hope wish pray deserve should ought better hoffe wunsche sollst sollte ojala espero deberia espere souhaite devrait".split()
STALK = """find know live lives wait waiting come coming visit follow following watch watching address house home office tonight alone sleep wake swear regret sorry safe dark car
finde weiss wohnst warte komme heute nacht adresse encontrare vives espero casa noche trouverai sais habites attends maison soir""".split()
GROUP = """immigrant immigrants refugee refugees foreigner foreigners migrants migrant villagers women woman females female gay gays lesbians lesbian trans disabled muslims muslim jews jew jewish
blacks asians arabs gypsies gypsy mexicans africans indians chinese christians cripples elderly old people folk kind breed those natives
auslander fluchtlinge frauen schwule juden muslime behinderte zigeuner leute inmigrantes extranjeros refugiados mujeres maricones gitanos moros gente negros
etrangers immigres refugies femmes arabes juifs musulmans gens noirs handicapes""".split()
DEHUMAN = """vermin subhuman filth scum animals animal cockroaches cockroach rats plague disease infest breed inferior savages parasites pest dirt garbage cattle sterilised sterilized exterminated exterminate wiped cleansed
abschaum ungeziefer untermenschen dreck vernichtet ratten escoria ratas alimanas plaga vermine racaille rats parasites""".split()
EXCLUDE = """out rid cage gutter deported deport thrown banned country belong belongs kitchen never let away gone border ship locked camp camps fault blame ruin ruined stealing steal trust
raus rausgeworfen weg abschieben land schuld fuera expulsar pais culpa dehors expulser pays faute""".split()
SEXUAL = """xxx porn porno nudes tits boobs pussy horny whore slut hooker hookup blowjob cum masturbate erotic sexy escort camgirl milf orgasm nipples
nackt nacktbilder geil geile schlampe hure titten muschi nutte desnuda desnudas zorra tetas polla follar perra cachonda salope baiser baise seins nue nues chaud chaude pute""".split()
WEAK_SEXUAL = """sex sexual naked nude strip lick girls girl bed sleeps lap oral anal dick cock undress bra panties underwear body hot kiss bedroom pervert shower nu photos fotos bilder pics pictures videos video beine""".split()
SOLICIT = """send show dm selling sell chat cam meet private looking pics pictures photos inbox message schick schicke zeig envoie envoyer montre mandame enseneme""".split()
WORTH = """nobody noone miss notice favor favour disappear vanish quit exist existence born breathing care wants everyone world better without
niemand keiner vermissen vermisst verschwinde nadie extrana desaparece personne manquera disparais""".split()
COMMAND = "shut off stop halt hau geh ferme casse vete callate cierra lick eat suck choke kneel".split()
SECOND = """you your yours yourself u ur youre du dich dir dein deine deinen deiner ihr euch tu te ti tus tuyo eres ton ta tes toi vous votre vos usted""".split()
PERSON = "he she him her his they them whoever who someone er sie der die el ella il elle lui".split()
NAMING = """words word note notes page checklist posts post deleted removed removes policy moderation filter proof term terms rule rules quote quoted says list listed called warns training wort worter liste palabra palabras mot mots
money flow hedge butterfly candle bears bulls market index order orders stop""".split()
TECHNICAL = """process processes job jobs server worker thread child orphan parent switch abort queue log logs report reports script disk node container session command backtest strategy setup entry position
volume chart candle trend spread breakout hedge loss losses trade trades appendix table desk meeting weekend noon""".split()
SELF = "feel felt i im me my mine myself ich mich mir mein yo mi je moi mon we our".split()
POLITE = "please thanks thank great nice good welcome glad appreciate happy works luck congratulations bitte danke gut gracias merci bueno bon".split()
KINDS = {
    "insult": INSULT, "degrade": DEGRADE, "vulgar": VULGAR, "harm": HARM, "body": BODY, "family": FAMILY, "wish": WISH, "stalk": STALK, "group": GROUP, "dehuman": DEHUMAN, "exclude": EXCLUDE,
    "sexual": SEXUAL, "weak_sexual": WEAK_SEXUAL, "solicit": SOLICIT, "worth": WORTH, "command": COMMAND, "second": SECOND, "person": PERSON, "naming": NAMING, "technical": TECHNICAL,
    "self": SELF, "polite": POLITE,
}
#: Kinds whose words people disguise and inflect.
_STRONG = frozenset(("insult", "degrade", "vulgar", "harm", "dehuman", "sexual", "weak_sexual"))
_INFLECTED = _STRONG | {"wish"}

_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_RUN = re.compile(r"(.)\1\1")
_REPEAT = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\-.*_ ]{1,2}){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[^\s\"(),;:?/\\]*[^\W_$@*])?|[@$][^\W_]+|[.!?…]+(?=\s|$)|\n")
_SUFFIX = re.compile(r"(?:ing|ed|es|er|est|en|s|e|y)$")


def _bare(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("ß", "ss")


def _lexicon() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for kind, ws in KINDS.items():
        for w in ws:
            out.setdefault(w, set()).add(kind)
    return {w: frozenset(k) for w, k in out.items()}


LEXICON = _lexicon()
_COLLAPSED = {_REPEAT.sub(r"\1", w): w for w, k in sorted(LEXICON.items(), reverse=True) if len(w) > 3 and not k.isdisjoint(_STRONG)}
_BY_LENGTH: dict[int, list[str]] = {}
for _w, _k in LEXICON.items():
    if len(_w) >= 4 and not _k.isdisjoint(_STRONG):
        _BY_LENGTH.setdefault(len(_w), []).append(_w)
_NONE: frozenset[str] = frozenset()


@lru_cache(maxsize=200_000)
def read_word(token: str) -> tuple[str, frozenset[str], bool]:
    """The word a token stands for, its kinds, and whether a disguise had to be undone to tell."""
    w = _bare(token)
    if w in LEXICON:
        mixed = token[1:] != token[1:].lower() and token[1:] != token[1:].upper() and not LEXICON[w].isdisjoint(_STRONG)
        return w, LEXICON[w], mixed
    if w.isalpha():
        if len(w) > 4:  # an inflected form of a word people inflect
            for stem in (_SUFFIX.sub("", w), _SUFFIX.sub("", w) + "e"):
                if len(stem) > 3 and not LEXICON.get(stem, _NONE).isdisjoint(_INFLECTED):
                    return stem, LEXICON[stem] & _INFLECTED, False
        if _RUN.search(w) and (full := _COLLAPSED.get(_REPEAT.sub(r"\1", w))):
            return full, LEXICON[full], True
        return w, _NONE, False
    if any(c.isalpha() for c in w):
        joined = re.sub(r"[\-._'’*]", "", w)
        for shape in (joined, joined.translate(_LEET), _COLLAPSED.get(_REPEAT.sub(r"\1", joined.translate(_LEET)), "")):
            if shape in LEXICON and (shape == joined or not LEXICON[shape].isdisjoint(_STRONG)):
                return shape, LEXICON[shape], not LEXICON[shape].isdisjoint(_STRONG)
        if "*" in w:
            pattern = re.compile(re.escape(w).replace(r"\*", "."))  # a mask hides one letter each
            for cand in _BY_LENGTH.get(len(w), ()):
                if pattern.fullmatch(cand):
                    return cand, LEXICON[cand], True
        parts = [p for p in re.split(r"[\-.'’]", w) if p in LEXICON]
        if parts:
            return parts[0], frozenset().union(*(LEXICON[p] for p in parts)), False
    return w, _NONE, False


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


#: Pairs of kinds counted when near each other: hostile ones, and those that explain a word away.
_HOSTILE = (
    *[("second", k) for k in ("insult", "degrade", "vulgar", "harm", "sexual", "weak_sexual", "body", "worth")], ("family", "harm"), ("family", "insult"), ("wish", "harm"), ("body", "harm"),
    ("stalk", "harm"), ("group", "dehuman"), ("group", "exclude"), ("group", "insult"), ("group", "degrade"), ("group", "harm"), ("person", "insult"), ("person", "sexual"), ("solicit", "sexual"),
    ("solicit", "weak_sexual"), ("weak_sexual", "sexual"), ("worth", "harm"), ("worth", "degrade"), ("command", "vulgar"), ("command", "degrade"), ("command", "insult"), ("insult", "degrade"), ("insult", "vulgar"),
)
_CALM = (("insult", "naming"), ("insult", "self"), ("degrade", "naming"), ("degrade", "technical"), ("harm", "technical"), ("harm", "self"), ("vulgar", "naming"), ("vulgar", "technical"), ("weak_sexual", "technical"))
_DENSE = ("insult", "degrade", "vulgar", "harm", "group", "dehuman", "sexual", "weak_sexual")
FEATURES = [
    *[f"density_{k}" for k in _DENSE], *[f"{a}_{b}" for a, b in _HOSTILE], "stalk_stalk_second", "naked_insult", "naked_sexual", "aggression",
    "obfuscation", "obfuscated", "learnt_top", "learnt_next", *[f"{a}_{b}" for a, b in _CALM], "polite", "capitals", "exclaim", "length",
]
#: Features that may only raise the score: all the hostile ones.
RAISING = np.array([f not in {f"{a}_{b}" for a, b in _CALM} | {"polite", "capitals", "exclaim", "length"} for f in FEATURES])
_LEARNT = slice(FEATURES.index("learnt_top"), FEATURES.index("learnt_next") + 1)
#: Words of a sentence that are scored together by what was learnt.
SPAN = 16


def read_text(text: str | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Dense features of one whole text without the learnt ones (0), hashed words and pairs, and their sentence.

    Sentences over ``SPAN`` words are cut every half a span. Zeros for no text.
    """
    t = plain(text)
    if any(c in t for c in "-.*_ "):
        t = _SPACED.sub(lambda m: re.sub(r"[\-.*_ ]", "", m.group()), t)
    at: dict[str, list[int]] = {k: [] for k in KINDS}
    pos, n, hidden, codes, spans, before, span, since = 0, 0, 0, [], [], 0, 0, 0
    for tok in _TOKEN.findall(t):
        if tok[0] in ".!?…\n":
            if tok != "\n" or since > 3:
                pos, before, span, since = pos + NEAR + 1, 0, span + 1, 0
            continue
        word, kinds, undone = read_word(tok)
        for k in kinds:
            at[k].append(pos)
        hidden += undone
        if not any(c.isdigit() for c in word) and not word.endswith("usdt"):
            code = _code(word)
            codes.append(code % SLOTS)
            spans.append(span)
            if before:
                codes.append((before * 31 + code) % SLOTS)
                spans.append(span)
            before = code
        else:
            before = 0
        pos, n, since = pos + 1, n + 1, since + 1
        if since % (SPAN // 2) == 0:
            span += 1
    out = np.zeros(len(FEATURES))
    if not n:
        return out, np.zeros(0, np.int64), []

    def near(a: str, b: str, d: int = NEAR) -> int:
        bs, hits = at[b], 0
        if bs:
            for i in at[a]:
                k = bisect_left(bs, i - d)
                while k < len(bs) and bs[k] == i:  # the word itself, of both kinds
                    k += 1
                hits += k < len(bs) and bs[k] <= i + d
        return hits

    value = dict.fromkeys(FEATURES, 0.0)
    for k in _DENSE:
        value[f"density_{k}"] = 100.0 * len(at[k]) / n
    for a, b in (*_HOSTILE, *_CALM):
        value[f"{a}_{b}"] = float(near(b, a))
    stalk = at["stalk"]
    around = [bisect_right(stalk, i + NEAR) - bisect_left(stalk, i - NEAR) - (bisect_right(stalk, i) - bisect_left(stalk, i)) for i in at["second"]]  # without the word itself
    value["stalk_stalk_second"] = float(sum(k > 1 for k in around))
    value["naked_insult"] = float(max(0, len(at["insult"]) - near("insult", "naming") - near("insult", "self")))
    value["naked_sexual"] = float(max(0, len(at["sexual"]) - near("sexual", "naming") - near("sexual", "technical")))
    value["aggression"] = float(sum(value[f"{a}_{b}"] > 0 for a, b in _HOSTILE))
    value["polite"] = 100.0 * len(at["polite"]) / n
    letters = sum(c.isalpha() for c in t)
    value["capitals"] = sum(c.isupper() for c in t) / letters if letters else 0.0
    value["exclaim"] = 100.0 * t.count("!") / n
    value["obfuscation"], value["obfuscated"] = 100.0 * hidden / n, float(hidden)
    value["length"] = float(np.log1p(n))
    return np.array(list(value.values())), np.array(codes, dtype=np.int64), spans


def learnt_features(codes: np.ndarray, spans: list[int], odds: np.ndarray) -> tuple[float, float]:
    """Summed log-odds of the text's best span and its neighbour, and of the next best apart from these."""
    if not len(codes):
        return 0.0, 0.0
    per = np.bincount(np.array(spans), odds[codes])
    both = np.maximum(per, per + np.concatenate([per[1:], [0.0]]))  # a wording may lie across the cut of a long sentence
    top = int(both.argmax())
    rest = np.delete(both, [k for k in (top - 1, top, top + 1) if 0 <= k < len(both)])
    return float(both[top]), float(rest.max()) if len(rest) else 0.0


def log_odds(rows: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds of hashed words and pairs between texts rated abusive and others, each counted once a text.

    Shrunk to 0 by ``PRIOR`` texts of the average kind; nothing is learnt of what fewer than
    ``LEAST_TEXTS`` texts hold, which a wrong rating or two would decide.
    """
    good, bad = np.zeros(SLOTS), np.zeros(SLOTS)
    for codes, p, k in zip(rows, y, w):
        once = np.unique(codes)
        bad[once] += p * k
        good[once] += (1 - p) * k
    share = max(float((y * w).sum()), 0.5) / max(float(w.sum()), 1.0)
    share = min(max(share, 1e-3), 1 - 1e-3)
    odds = np.log((bad + PRIOR * share) / (good + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return np.where(bad + good >= LEAST_TEXTS, np.clip(odds, -1.0, 3.0), 0.0)


# ---------------------------------------------------------------- boosted trees


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Bin borders: between the distinct values where there are few, else of equal weight."""
    out = []
    for c in x.T:
        u = np.unique(c)
        out.append(u[:-1] if len(u) <= bins else np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
    return out


def _tree(b: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: list[int], depth: int, reg: float, least: float, lo: float, hi: float) -> tuple:
    """Nested (feature, bin, left, right) or a leaf value within (lo, hi); rows with code <= bin go left.

    Along a raising feature the right side's values are never below the left side's.
    """
    leaf = float(np.clip(-g.sum() / (h.sum() + reg), lo, hi))
    if depth == 0 or h.sum() < 2 * least:
        return (leaf,)
    best, where = 1e-6, None
    parent = g.sum() ** 2 / (h.sum() + reg)
    for f, k in enumerate(sizes):
        if k < 2:
            continue
        gl, hl = np.cumsum(np.bincount(b[:, f], g, k))[:-1], np.cumsum(np.bincount(b[:, f], h, k))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + reg) + gr**2 / (hr + reg) - parent, 0)
        if RAISING[f]:
            gain = np.where(-gl / (hl + reg) <= -gr / (hr + reg), gain, 0)
        i = int(gain.argmax())
        if gain[i] > best:
            best, where = float(gain[i]), (f, i, np.clip(-gl[i] / (hl[i] + reg), lo, hi), np.clip(-gr[i] / (hr[i] + reg), lo, hi))
    if not where:
        return (leaf,)
    f, i, vl, vr = where
    left, mid = b[:, f] <= i, float(vl + vr) / 2
    bounds = ((lo, mid), (mid, hi)) if RAISING[f] else ((lo, hi), (lo, hi))
    return (f, i, _tree(b[left], g[left], h[left], sizes, depth - 1, reg, least, *bounds[0]), _tree(b[~left], g[~left], h[~left], sizes, depth - 1, reg, least, *bounds[1]))


def _leaf(tree: tuple, b: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(b), tree[0])
    left = b[:, tree[0]] <= tree[1]
    out = np.empty(len(b))
    out[left], out[~left] = _leaf(tree[2], b[left]), _leaf(tree[3], b[~left])
    return out


class BoostedTrees:
    """Binary log-loss boosting on histogram bins, with sample weights, monotone in the hostile features."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, reg: float = 1.0, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.reg, self.least = rounds, depth, rate, bins, reg, least

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        self.edges = _edges(x, self.bins)
        b, sizes = self._codes(x), [len(e) + 1 for e in self.edges]
        share = float(((y * w).sum() + 0.5) / (w.sum() + 1))
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = _tree(b, w * (q - y), w * q * (1 - q), sizes, self.depth, self.reg, self.least, -np.inf, np.inf)
            self.trees.append(tree)
            score += self.rate * _leaf(tree, b)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, out = self._codes(x), np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * _leaf(tree, b)
        return out


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: one knot (score, probability) per distinct score, non-decreasing.

    Equal scores are pooled first, so that the order of the rows does not count.
    """
    s, which = np.unique(score, return_inverse=True)
    weight = np.bincount(which, w)
    total = np.bincount(which, y * w)
    blocks: list[list[float]] = []
    for v, k in zip(total, weight):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, k2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + k2, blocks[-1][2] + n2]
    return s, np.concatenate([np.full(int(n), v / k) for v, k, n in blocks]) if blocks else np.zeros(0)


class AbuseModel:
    """Learnt log-odds, trees and calibration; ``probability`` scores texts."""

    def __init__(self) -> None:
        self.odds = np.zeros(SLOTS)
        self.trees: BoostedTrees | None = None

    def fit(self, texts: list[str], y: np.ndarray, w: np.ndarray, fold: np.ndarray) -> AbuseModel:
        """Fit on rated ``texts`` and the seeds. ``fold`` (0 to FOLDS - 1) tells what is held out together."""
        n = len(texts)
        seeds = [*ABUSIVE_SEEDS, *CLEAN_SEEDS]
        texts = [*texts, *seeds]
        y = np.concatenate([y, np.ones(len(ABUSIVE_SEEDS)), np.zeros(len(CLEAN_SEEDS))])
        w = np.concatenate([w, np.ones(len(seeds))])
        fold = np.concatenate([fold, np.arange(len(seeds)) % FOLDS])
        read = [read_text(t) for t in texts]
        x = np.array([r[0] for r in read])
        rows = [r[1] for r in read]
        # what is learnt of words must not come from the row's own rating
        for k in range(FOLDS):
            odds = log_odds([r for r, f in zip(rows, fold) if f != k], y[fold != k], w[fold != k])
            for i in np.flatnonzero(fold == k):
                x[i, _LEARNT] = learnt_features(rows[i], read[i][2], odds)
        held = np.empty(len(y))
        for k in range(FOLDS):
            held[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k], w[fold != k]).score(x[fold == k])
        # seeds are no sample of the documents; they calibrate only while there are hardly any ratings
        share = np.where(np.arange(len(y)) < n, 1.0, min(1.0, 20.0 / max(n, 1)))
        self.knots = isotonic(held, y, w * share)
        self.trees = BoostedTrees().fit(x, y, w)
        self.odds = log_odds(rows, y, w)
        return self

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        for i, t in enumerate(texts):
            out[i], codes, spans = read_text(t)
            out[i, _LEARNT] = learnt_features(codes, spans, self.odds)
        return out

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return np.interp(self.trees.score(self.features(texts)), *self.knots) if len(texts) else np.zeros(0)


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "abusive", seed: int = 0) -> AbuseModel:
    """Fit on at most ``MAX_LABELLED`` rated documents and the seeds of :mod:`tidemark.llm.seeds`.

    Null ratings are ignored; several ratings of a document are averaged and weigh by their number.
    Of several texts of one id the smallest counts. The order of the rows does not matter. Without
    any ratings the seeds alone are fitted.
    """
    rated = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.avg(label).alias("_y"), F.count("*").alias("_w"))
    place = F.xxhash64(F.col(doc_id), F.lit(seed))
    rated = rated.orderBy(place, doc_id).limit(MAX_LABELLED)
    docs = documents.select(doc_id, F.col(text).alias("_t")).join(F.broadcast(rated), doc_id).groupBy(doc_id, "_y", "_w").agg(F.min("_t").alias("_t"))
    rows = docs.select("_t", "_y", "_w", place.alias("_p"), F.pmod(place, F.lit(FOLDS)).cast("int").alias("_f")).collect()
    rows.sort(key=lambda r: (r["_p"], r["_t"] or ""))
    return AbuseModel().fit([r["_t"] or "" for r in rows], np.array([float(r["_y"]) for r in rows]), np.array([float(r["_w"]) for r in rows]), np.array([r["_f"] for r in rows], dtype=int))


def score(documents: DataFrame, model: AbuseModel, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns and ``abuse``: the calibrated probability of every document.

    Null and empty texts score like a text without any listed word. Each row is scored by itself.
    """
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({doc_id: b[doc_id], **{c: b[c] for c in keep}, "abuse": model.probability(list(b[text]))})

    return documents.select(doc_id, *keep, text).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (doc_id, *keep)) + ", abuse double")
