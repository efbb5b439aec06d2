"""Scores of abusive, hateful or sexual content.

Method: cumulative-link ordinal regression. Raters' opinions give each labelled text a severity grade (0 none, 1 some of
them, 2 all of them call it abusive); one weight vector over sparse text features serves both thresholds, and the score
is the expected severity. A text is as severe as its worst sentence, so the features are those of sentences; in an
abusive labelled text the sentence that scores highest stands for it while the weights are fitted.

The model is fitted on the driver on the hashed features, made in tasks, of at most ``MAX_LABELLED`` labelled texts, taken
in the order of a hash of their ids; every text is scored. Sentences are first freed of disguises: look-alike letters, invisible signs, spaced or stretched
letters, digits and signs for letters.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkyard.session import spread

MAX_LABELLED = 20_000
DIMENSIONS = 1 << 18
THRESHOLD = 0.5

# Words of abuse by kind, folded to plain small letters; a mark of the kind is one feature among others.
INSULT = frozenset(
    "idiot idiots moron morons imbecile imbeciles cretin cretins dumbass dumbasses dimwit dimwits halfwit nitwit jackass asshole assholes arsehole bastard bastards bitch bitches wanker wankers tosser prick dickhead twat cunt cunts retard retards retarded scum scumbag loser losers vermin worm pig swine fool jerk douchebag shithead shit fuckwit fucker motherfucker bellend slut whore faggot clown parasite parasites lowlife dipshit "
    "arschloch vollpfosten vollidiot idioten depp deppen trottel wichser hurensohn missgeburt schwachkopf dummkopf spast schlampe ungeziefer drecksau volltrottel mistkerl versager "
    "connard connards connasse encule abruti abrutis debile salope pute ordure batard cretine idiote salaud salauds minable "
    "idiota idiotas imbecil imbeciles gilipollas cabron cabrones inutil estupido pendejo puta mierda payaso subnormal tarado imbeciles".split()
)
SEXUAL = frozenset("naked nude nudes tits boobs blowjob porn porno horny pussy sexy fuck fucking dick cock jerking wank nackt nacktbilder nacktfotos titten ficken nue nues seins baiser desnuda desnudas tetas follar xxx sex sexe sexo".split())
VIOLENT = frozenset("kill die dead burn bleed slash slashed choke hang beat strangle murder tot sterben verrecke umbringen toten crever creve crevais mourir tuer matar muerete mueras muerto morir".split())
PEOPLE = frozenset("women woman girls gay gays immigrants immigrant foreigners muslims jews blacks disabled refugees trans frauen auslander fluchtlinge juden schwule femmes etrangers juifs arabes mujeres extranjeros inmigrantes gitanos".split())
PORN = frozenset("porn porno blowjob blowjobs horny tits titten tetas nudes nacktbilder nacktfotos jerking wank ficken follar".split())
DEMEAN = frozenset("stupid vermin parasite parasites plague disease animals steal kitchen filth subhuman disgust disgusts worthless useless pathetic brainless lazy herd ungeziefer dreck dumm cuisine parasites vermine plaga cocina ratas inutiles basura".split())
# Words met in disguise too, though no abuse by themselves.
DISGUISED = frozenset("stupid pathetic worthless useless worm waste oxygen brainless clown parasite lazy scumbag piece disgusting filthy monkey".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch tu te toi ton ta tes vous votre eres usted vosotros ti contigo tus".split())
FIRST = frozenset("i me my myself mine ich mich mir mein meine je moi mon ma mes yo mi mio soy".split())
ZH = {"insult": "脑残 白痴 蠢货 混蛋 傻逼 傻瓜 垃圾人 废物 王八蛋 智障 贱人 婊子 闭嘴 人渣 畜生 狗东西 蠢猪".split(), "sexual": "裸照 裸聊 色情 脱光 上床 性爱".split(), "porn": "裸照 裸聊 色情".split(), "demean": "害虫 厨房 垃圾人 畜生 低等".split(), "violent": "去死 弄死 打死 砍死 走着瞧 杀了你".split(), "people": "女人 同性恋 外国人 外地人 黑人 残疾人".split(), "second": "你".split()}
LOOK_ALIKE = dict(zip("асеорхукіјѕԁһԛԝмнтвгαοερνικτυ", "aceopxykijsdhqwmhtbraoepviktu"))
LEET = str.maketrans("@$0134578!|+", "asoieastbiit")

_FOLD = str.maketrans({**LOOK_ALIKE, **{c: None for c in map(chr, [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0xAD, 0x180E])}})
_SPEAKER = re.compile(r"(?m)^\s*(?:[-*>#]+\s*)?dev\d+:\s*")
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\n\r]+|\s//\s")
_SPACED = re.compile(r"(?<![\w'])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![\w'])")
_ID = re.compile(r"`[^`]*`|https?://\S+|\b[\w$]*(?:[_/][\w.]+)+(?:\(\))?|\b\w+(?:\.\w+)+\b")
_WORD = re.compile(r"[^\W\d_](?:[\w*'@$!]*[\w*@$])?|[@$*\d][\w@$*!]*[^\W_]|[一-鿿]+|'|\"")
_RUN = re.compile(r"(.)\1{2,}")
_TWICE = re.compile(r"(.)\1+")
_HAN = re.compile(r"[一-鿿]")
_HAN_GAP = re.compile(r"(?<=[一-鿿])[ \-_*·.]{1,2}(?=[一-鿿])")
WINDOW, STEP, LONG = 10, 3, 12
# Lengths of the beginnings of words that are features too; measured, they add nothing to whole words, pairs and threes.
PREFIXES: tuple[int, ...] = ()
_ALL = INSULT | SEXUAL
_KNOWN = _ALL | DISGUISED
_SQUEEZED = {_TWICE.sub(r"\1", w): w for w in sorted(_KNOWN)}
_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(_KNOWN):
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


def fold(text: str) -> str:
    """Small letters without accents, look-alikes and invisible signs; Chinese and other scripts stay."""
    t = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    if t.isascii():
        return t
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not ("̀" <= c <= "ͯ"))).replace("ß", "ss")


@lru_cache(200_000)
def plain(word: str) -> str:
    """The word behind a disguise: a known one if the signs allow it, otherwise the word itself, or # for an identifier."""
    if word.isalpha():
        if word in _KNOWN:
            return word
        if word[0] == "a" and word[1:] in INSULT:  # an article that lost its space
            return word[1:]
        w = _RUN.sub(r"\1", word)
        return _SQUEEZED.get(_TWICE.sub(r"\1", word), w) if w != word else word
    if "*" in word:
        rx = re.compile(word.translate(LEET).replace("*", r"\w") + r"\Z")
        for w in _BY_LENGTH.get(len(word), ()):
            if rx.match(w):
                return w
        return "#"
    if "'" in word:
        return word
    w = word.translate(LEET)
    if w in _KNOWN:
        return w
    return _SQUEEZED.get(_TWICE.sub(r"\1", w), "#")


def sentences(text: str) -> list[str]:
    """The sentences and lines of a text, folded, identifiers and paths replaced by one sign."""
    out = []
    for s in _SPLIT.split(_SPEAKER.sub("", fold(text))):
        s = s.strip()
        if s:
            s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), s)
            if not s.isascii():
                s = _HAN_GAP.sub("", s)
            if "`" in s or "/" in s or "_" in s or "." in s:  # no identifier without one of these
                s = _ID.sub(" # ", s)
            out.append(s)
    return out


class Token(NamedTuple):
    """A word behind its disguise: how it stands in pairs and threes, its own features, its marks, and whether it is a quote."""

    shape: int
    own: tuple[int, ...]
    marks: frozenset[str]
    insult: bool
    quote: bool
    han: bool


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) % DIMENSIONS


def _mix(*parts: int) -> int:
    h = 17
    for p in parts:
        h = (h * 1_000_003 ^ p) & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMENSIONS


@lru_cache(200_000)
def token(w: str) -> Token:
    """One word or run of Chinese signs, with the beginnings of ``PREFIXES`` as features of its own."""
    if w in ("'", '"'):
        return Token(0, (), frozenset(), False, True, False)
    if _HAN.match(w):
        w = _RUN.sub(r"\1", w)
        marks = frozenset(kind for kind, known in ZH.items() if any(x in w for x in known))
        return Token(0, tuple({_hash(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}), marks, False, False, True)
    w = plain(w)
    kinds = {"insult": INSULT, "sexual": SEXUAL, "violent": VIOLENT, "people": PEOPLE, "second": SECOND, "porn": PORN, "demean": DEMEAN, "first": FIRST}

    parts = {_hash("~" + w[:n]) for n in PREFIXES if len(w) > n}
    return Token(_hash("[insult]" if w in INSULT else w), tuple({_hash(w)} | parts), frozenset(k for k, known in kinds.items() if w in known), w in INSULT, False, False)


@lru_cache(200_000)
def tokens(word: str) -> tuple[Token, ...]:
    """The tokens of a stretch without white space."""
    return tuple(token(w) for w in _WORD.findall(word))


_BEGIN, _END = _hash("<"), _hash(">")


class Row:
    """The tokens of a sentence with their pairs and threes, of which any stretch takes its part."""

    def __init__(self, sentence: str):
        self.row: list[Token] = []
        self.at = [0]  # where each word's tokens begin
        for w in sentence.split():
            self.row += tokens(w)
            self.at.append(len(self.row))
        self.flat: list[int] = []  # the words that stand in pairs and threes
        self.upto = [0]
        for t in self.row:
            if not (t.quote or t.han):
                self.flat.append(t.shape)
            self.upto.append(len(self.flat))
        self.pairs = [_mix(a, b) for a, b in zip(self.flat, self.flat[1:])]
        self.threes = [_mix(a, b, c) for a, b, c in zip(self.flat, self.flat[1:], self.flat[2:])]

    def stretch(self, first: int, last: int) -> tuple[int, ...]:
        """Hashed features of the words from ``first`` to ``last``: words with their parts, pairs, threes, Chinese pairs and
        threes, marks and marks together."""
        a, b = self.at[first], self.at[last]
        row = self.row[a:b]
        f = set().union(*[t.own for t in row])
        marks = set().union(*[t.marks for t in row if t.marks])
        if "insult" in marks and any(t.insult and row[n - 1].quote for n, t in enumerate(row[1:-1], 1)):
            marks.add("named")
        i, j = self.upto[a], self.upto[b]
        f.update(self.pairs[i : max(i, j - 1)])
        f.update(self.threes[i : max(i, j - 2)])
        ends = [_BEGIN, *self.flat[i : min(j, i + 2)]], [*self.flat[max(i, j - 2) : j], _END]
        if j - i < 2:
            ends[0].append(_END)
        f.add(_mix(*ends[0][:2]))
        f.add(_mix(*ends[1][-2:]) if i < j else _mix(_BEGIN, _END))
        if i < j:
            f.add(_mix(*ends[0][:3]))
        if j - i > 1:
            f.add(_mix(*ends[1][-3:]))
        if marks:
            m = sorted(marks)
            f.update(_hash(f"[{x}]") for x in m)
            f.update(_hash(f"[{x}+{y}]") for k, x in enumerate(m) for y in m[k + 1 :])
        return tuple(sorted(f))


def features(sentence: str) -> tuple[int, ...]:
    """The features of one whole sentence."""
    r = Row(sentence)
    return r.stretch(0, len(r.at) - 1)


@lru_cache(50_000)
def stretches(sentence: str) -> tuple[tuple[int, ...], ...]:
    """Features of a sentence and, if it is long, of overlapping stretches: a missing full stop shall not dilute what it says."""
    r = Row(sentence)
    n = len(r.at) - 1
    if n <= LONG:
        return (r.stretch(0, n),)
    return (r.stretch(0, n), *(r.stretch(i, min(n, i + WINDOW)) for i in range(0, n - WINDOW + STEP, STEP)))


class Model:
    """Weights and two ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights.tolist(), cuts.tolist()  # a list is read faster than an array, number by number
        self.array = weights
        self.known: dict[tuple[int, ...], float] = {}

    def severity(self, f: tuple[int, ...]) -> float:
        """The expected grade of a sentence, scaled to 0..1."""
        v = self.known.get(f)
        if v is None:
            if len(self.known) > 200_000:
                self.known.clear()
            z = sum(map(self.weights.__getitem__, f))
            v = self.known[f] = sum(1 / (1 + exp(min(max(c - z, -40.0), 40.0))) for c in self.cuts) / len(self.cuts)
        return v

    def score(self, text: str | None) -> float:
        """The severity of the worst sentence or stretch; 0 for a null, empty or blank text."""
        return max((self.severity(f) for s in sentences(text or "") for f in stretches(s)), default=0.0)


def _fit(rows: list[tuple[int, ...]], grade: np.ndarray, weight: np.ndarray, start: np.ndarray, cuts: np.ndarray, prior: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum a posteriori by Adam over all rows: shared weights, cumulative logits against two cuts."""
    n = np.array([len(r) for r in rows])
    col = np.fromiter((x for r in rows for x in r), np.int64, int(n.sum()))
    row = np.repeat(np.arange(len(rows)), n)
    used, col = np.unique(col, return_inverse=True)
    w, p = start[used].copy(), prior[used]
    above = np.stack([grade > 0, grade > 1]).astype(float)
    total = weight.sum()
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros(2), np.zeros(2)
    cuts = cuts.copy()
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows))
        err = (1 / (1 + np.exp(np.clip(cuts[:, None] - z, -40, 40))) - above) * weight / total
        g = np.bincount(col, err.sum(0)[row], len(w)) + decay * (w - p)
        gc = -err.sum(1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc * gc
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (m / a) / (np.sqrt(v / b) + 1e-9)
        cuts -= 0.05 * (mc / a) / (np.sqrt(vc / b) + 1e-9)
        if cuts[1] < cuts[0]:
            cuts[:] = cuts.mean()
    out = prior.copy()
    out[used] = w
    return out, cuts


def _prior() -> np.ndarray:
    """Where weights stand before any label: marks of abuse aimed at a person count, words alone less."""
    p = np.zeros(DIMENSIONS)
    for k, x in {"[insult]": 1.5, "[insult+second]": 3.0, "[sexual]": 0.5, "[porn]": 4.0, "[second+sexual]": 3.0, "[second+violent]": 2.0, "[people+violent]": 2.0, "[demean+people]": 4.5, "[demean+second]": 2.0, "[insult+people]": 4.0, "[insult+named]": -3.0, "[first+insult]": -1.5}.items():
        p[_hash(k)] = x
    p[_mix(_BEGIN, _hash("[insult]"), _END)] = 3.0  # a sentence of nothing else
    return p


def described(text: str | None) -> list[tuple[int, ...]]:
    """The features of each sentence of a text, each once; an empty text has one sentence without features."""
    return list(dict.fromkeys(features(s) for s in sentences(text or ""))) or [()]


def fit(labelled: list[tuple[str | None, float]], rounds: int = 4, steps: int = 150, decay: float = 0.027) -> Model:
    """The model of texts with the share of raters who called them abusive."""
    return fit_described([(described(t), s) for t, s in labelled], rounds, steps, decay)


def fit_described(labelled: list[tuple[list[tuple[int, ...]], float]], rounds: int = 4, steps: int = 150, decay: float = 0.027) -> Model:
    """The model of texts given by their sentences' features, with the share of raters who called them abusive.

    Raters err: an abusive label on a text without any telling sentence, and a clean one on a text with a plainly
    abusive sentence, count for little from the second round on.
    """
    texts = [t for t, _ in labelled]
    grade = np.array([2 if s >= 0.99 else 1 if s > 0.01 else 0 for _, s in labelled])
    prior = _prior()
    model = Model(prior, np.array([3.0, 3.5]))
    decay /= max(len(labelled), 1) ** 0.5  # fewer labels leave the weights nearer to where they stood
    if not labelled or not (grade > 0).any():
        return model
    # how much more often a sentence's features occur in abusive texts than elsewhere picks the first representatives
    seen, bad = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for t, g in zip(texts, grade):
        cols = list({x for f in t for x in f})
        seen[cols] += 1
        if g:
            bad[cols] += 1
    odds = np.log((bad + 0.3) / (seen - bad + 3.0)) - np.log((grade > 0).mean() + 1e-9)
    def first(f: tuple[int, ...]) -> float:
        return (max(float(odds[list(f)].max()), 0.0) if f else 0.0) + float(prior[list(f)].sum())

    for k in range(rounds):
        say = model.severity if k else first
        rows: dict[tuple[tuple[int, ...], int], float] = {}
        for t, g in zip(texts, grade):
            if g:
                f = max(t, key=say)
                trust = 1.0 if say(f) >= (0.3 if k else 1.5) else 0.05
                rows[(f, int(g))] = rows.get((f, int(g)), 0.0) + trust
            else:
                for f in t:
                    rows[(f, 0)] = rows.get((f, 0), 0.0) + (0.1 if k and model.severity(f) > 0.9 else 1.0)
        keys = list(rows)
        # a sentence met a thousand times is no thousand times as telling
        weight = np.array([rows[x] ** 0.75 for x in keys])
        w, c = _fit([x[0] for x in keys], np.array([x[1] for x in keys]), weight, model.array, np.array(model.cuts), prior, steps, decay)
        model = Model(w, c)
    return model


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The model from labelled documents; opinions on a document are averaged, null opinions left out."""
    share = labels.where("toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("share"))
    chosen = share.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "text", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([described(t) for t in b.column("text").to_pylist()], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found, b.column("share")], ["doc_id", "found", "share"])

    rows = texts.mapInArrow(run, "doc_id bigint, found array<array<int>>, share double").toArrow().sort_by("doc_id")
    return fit_described([([tuple(f) for f in fs], s) for fs, s in zip(rows.column("found").to_pylist(), rows.column("share").to_pylist())])


def score(docs: DataFrame, model: Model, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``others`` and ``severity`` from 0 to 1 of every document.

    Null, empty and blank texts score 0; repeated rows score alike; other columns are ignored; an empty table gives an
    empty result.
    """
    cols = docs.selectExpr("doc_id", *(f"`{c}`" for c in others), "text as __text")
    fields = ", ".join(f"`{n}` {t}" for n, t in cols.dtypes if n != "__text")
    held = docs.sparkSession.sparkContext.broadcast((model.array.astype(np.float32), np.array(model.cuts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            s = [round(m.score(t), 6) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *others)), pa.array(s, pa.float64())], ["doc_id", *others, "severity"])

    return spread(cols).mapInArrow(run, f"{fields}, severity double")
