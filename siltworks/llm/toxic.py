"""Problem 3: abusive, hateful or sexually explicit content.

A linear-chain conditional random field tags toxic tokens.  It is fitted on tagged sentences built
from small lexicons (with disguised spellings and with harmless uses of the same words), and on
sentences of labelled documents: those of documents rated clean are untagged throughout, and those
of documents rated toxic are tagged where their word pairs hardly occur in clean documents.
Forward-backward marginals give toxic spans with offsets, a score per sentence and per document.

At most ``TRAIN_ROWS`` documents rated toxic and ``CLEAN_ROWS`` rated clean are used for fitting.

Defined results: null or blank text scores 0 with no spans; repeated rows give equal rows; documents
without a rating are scored like others; a null source is a source of its own in the rates.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from siltworks.llm import prose as P
from siltworks.llm.batches import map_columns
from siltworks.llm.crf import Crf, feature_ids, mix, posterior

#: Most documents rated toxic, and most rated clean, used for fitting.
TRAIN_ROWS, CLEAN_ROWS = 500, 2500
THRESHOLD = 0.5

# Words of abuse by kind, without accents; fixed values.
INSULTS = """idiot idiots moron morons imbecile cretin dumbass jackass dimwit halfwit nitwit loser losers scum scumbag scumbags bastard bastards
bitch bitches asshole assholes arsehole shithead dickhead dumb-ass prick wanker twat douchebag retard retarded pig swine rat vermin trash garbage filth piece
liar coward pathetic worthless disgusting stupid brainless gutless filthy ugly slut whore cunt motherfucker fucker freak creep clown
arschloch wichser schwachkopf vollidiot idiot trottel depp hurensohn schlampe drecksau schwein missgeburt abschaum dreckiges wertloser dumme penner spast
connard connasse salope salaud pute ordure encule debile cretin abruti merde porc batard crevure
idiota imbecil gilipollas cabron puta puto cerdo basura escoria estupido zorra maricon mierda asqueroso maldito
imbecil otario burro vagabunda lixo nojento desgracado porco merda
идиот дурак дебил тварь мразь сука ублюдок урод скотина кретин придурок чмо шлюха
stronzo idiota bastardo puttana coglione klootzak hoer eikel sukkel""".split()
SEXUAL = """porn porno pornstar xxx nude nudes naked horny milf milfs busty babes boobs tits cock cocks dick pussy fuck fucks fucked fucking blowjob cum
cumshot hardcore uncensored strip moan orgasm anal suck sucked sucking slutty sexy sex cams webcam
nackte geile ficken fick fickt titten schwanz muschi nues chaudes baisent baise baiser bite chatte desnudas calientes follan follar polla tetas
nuas quentes fodem foder buceta порно голые секс трахают сиськи""".split()
VIOLENT = """kill die dead drown drowned rot beat bloody hang rape burn shoot stab choke hurt throat cage crawl bullet gutted lynch dragged
verreck verrecke ausgerottet vernichtet vergast zahne schlagen fresse creve crever casser figure gueule chasser mueras mueran romper cara callate boca echarlos golpes
morra morrer matar quebrar cala сдохни убить заткнись умри""".split()
GROUPS = """people women men folk immigrants foreigners jews muslims blacks whites gays lesbians refugees gypsies migrants kind race tribe subhuman subhumans vermin plague parasites
untermenschen ungeziefer parasiten auslander vermine gens etrangers parasites plaga gente inmigrantes velianos praga gentalha""".split()
REPORT = """removed report reports reported article essay study lesson lessons law laws explained explains explain court judge convicted moderators moderator post called
recorded offered screening museum microscope seventh library school researchers police documentary novel film exhibition statue painting carved script process worker queue job server printer backup
farmers barn stable comet crowed brayed""".split()
SECOND = """you your yours yourself u ur du dich dir dein deine euch tu toi te ton ta tes vous tus ti vosotros voce tua seu ты тебя тебе вы вас""".split()

_CLASS: dict[str, str] = {}
for _k, _ws in (("G", GROUPS), ("V", VIOLENT), ("S", SEXUAL), ("I", INSULTS)):
    for _w in _ws:
        _CLASS[_w] = _k
_REPORT, _SECOND = frozenset(REPORT), frozenset(SECOND)

_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){2,}[^\W\d_](?!\w)")
# What every spelled-out word holds, and little else does.
_SPELL_HINT = re.compile(r"[.\-_*][^\W\d_][.\-_*]")
_TOKEN = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){2,}[^\W\d_](?!\w)|\w+(?:[*@$#]+\w*)*|[*@$#]+\w+|[^\w\s]")
_LEET = str.maketrans("013457@$!", "oieastasi")


def plain(w: str) -> str:
    """Lower case without accents."""
    w = w.lower()
    if w.isascii():
        return w
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


@lru_cache(maxsize=50_000)
def undisguise(w: str) -> tuple[str, bool]:
    """The plain form of a token, and whether it was disguised (spelled out, masked or with digits)."""
    if _SPELLED.fullmatch(w):
        return plain(re.sub(r"[.\-_*]", "", w)), True
    p = plain(w)
    if p.isalpha() or p.isdigit() or not any(c.isalpha() for c in p):
        return p, False
    if re.fullmatch(r"[^\W\d_]+\d+|\d+[^\W\d_]+", p) and not re.fullmatch(r"[a-z]{2,}[01345]|[01345][a-z]{3,}", p):
        return p, False
    leet = p.translate(_LEET)
    if leet in _CLASS:
        return leet, True
    pat = re.compile("".join("." if not c.isalpha() else re.escape(c) for c in p))
    for k in _CLASS:
        if len(k) == len(p) and pat.fullmatch(k):
            return k, True
    return leet, any(c in "*@$#" for c in p) or bool(re.search(r"[a-z]\d[a-z]", p))


@lru_cache(maxsize=50_000)
def word_class(w: str) -> str:
    p, hid = undisguise(w)
    return _CLASS.get(p, "-") + ("h" if hid else "")


_FAST = re.compile(r"\w+(?:[*@$#]+\w*)*|[*@$#]+\w+|[^\w\s]")


_MASKED = re.compile(r"[*@$#]")
_SIMPLE = re.compile(r"\w+|[^\w\s]")
# Chinese has no blanks between words: each of its characters is a token.
_WIDE = re.compile(rf"[{P.CJK}]|[^\W{P.CJK}]+(?:[*@$#]+[^\W{P.CJK}]*)*|[*@$#]+[^\W{P.CJK}]+|[^\w\s]")


def _pattern(text: str, spelled: bool = True, masked: bool = True) -> re.Pattern:
    """What finds the tokens of a text; ``spelled`` and ``masked`` say whether it may hold such disguises."""
    if spelled and _SPELL_HINT.search(text) and _SPELLED.search(text):
        return _TOKEN
    if not text.isascii() and P._CJK.search(text):
        return _WIDE
    return _FAST if masked else _SIMPLE


def words_of(text: str, spelled: bool = True, masked: bool = True) -> list[str]:
    """Tokens in lower case."""
    return _pattern(text, spelled, masked).findall(text.lower())


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _pattern(text).finditer(text)]


def pieces(text: str) -> list[tuple[int, int]]:
    """Sentences, cut at blank lines too."""
    out, at = [], 0
    for para in text.split("\n\n"):
        if para:
            out += [(at + a, at + b) for a, b in P.sentences(para)]
        at += len(para) + 2
    return out


def flags(words: list[str]) -> str:
    s = set(words)
    return ("R" if s & _REPORT else "") + ("Y" if s & _SECOND else "")


@lru_cache(maxsize=50_000)
def hashes(w: str) -> tuple[int, int]:
    """Hashes of a token's plain form and of its class."""
    return zlib.crc32(undisguise(w)[0].encode("utf-8", "surrogatepass")), zlib.crc32(("k:" + word_class(w)).encode())


# Salts of the pair features: classes with the word before and after, words with the word before,
# after and two before.
_CLASS_BEFORE, _CLASS_AFTER, _BEFORE, _AFTER, _TWO_BEFORE = 1, 2, 3, 4, 5


def position_features(p2: str, p: str, c: str, n: str, fl: str) -> list[str | int]:
    base, k = undisguise(c)[0], word_class(c)
    (hc, kc), (hp, kp), (hn, kn), (h2, _) = hashes(c), hashes(p), hashes(n), hashes(p2)
    return [
        "c:" + base, "k:" + k, "pre:" + base[:4], "f:" + fl, "fk:" + fl + k, "bias",
        "p:" + undisguise(p)[0], "n:" + undisguise(n)[0],
        mix(kp, kc, _CLASS_BEFORE), mix(kc, kn, _CLASS_AFTER), mix(hp, hc, _BEFORE), mix(hc, hn, _AFTER), mix(h2, hc, _TWO_BEFORE),
    ]


class Tagger:
    """The fitted field, with emissions assembled from cached parts."""

    BITS = 17

    def __init__(self) -> None:
        self.crf = Crf(["ok", "toxic"], lambda key: position_features(*key.split("\x00")), bits=self.BITS)
        self._w: np.ndarray | None = None
        self._reset()

    @staticmethod
    def keys(words: list[str]) -> list[str]:
        fl = flags([undisguise(w)[0] for w in words])
        w = ["<", "<", *words, ">"]
        return ["\x00".join((w[i], w[i + 1], w[i + 2], w[i + 3], fl)) for i in range(len(words))]

    def fit(self, data: list[tuple[list[str], list[int]]]) -> "Tagger":
        self.crf.fit([self.keys(w) for w, _ in data], [t for _, t in data], epochs=6, rate=0.5, batch=512)
        return self

    def _class(self, k: str) -> int:
        """The number of a class of words; its own parts of the scores are made once."""
        j = self.classes.get(k)
        if j is None:
            j = self.classes[k] = len(self.classes)
            self.class_hash.append(zlib.crc32(("k:" + k).encode()))
            self.class_own.append([float(self.w[feature_ids(["k:" + k, "bias", "f:" + f, "fk:" + f + k], self.BITS)].sum()) for f in ("", "R", "Y", "RY")])
            h = np.array(self.class_hash, dtype=np.uint32)
            n = len(h)
            a, b = np.repeat(h, n), np.tile(h, n)
            m = np.uint32((1 << self.BITS) - 1)
            # The score of a class after another, for the later and for the earlier of the two.
            self.after = self.w[mix(a, b, _CLASS_BEFORE) & m].reshape(n, n)
            self.before = self.w[mix(a, b, _CLASS_AFTER) & m].reshape(n, n)
        return j

    def _learn(self) -> None:
        """Make the parts of the scores of the words met since the last call, all at once."""
        new = self.index.words[len(self.hash) :]
        if not new:
            return
        ids, hashed, kind, fact = [], [], [], []
        for w in new:
            b = undisguise(w)[0]
            ids += feature_ids(("c:" + b, "pre:" + b[:4], "p:" + b, "n:" + b), self.BITS)
            hashed.append(zlib.crc32(b.encode("utf-8", "surrogatepass")))
            kind.append(self._class(word_class(w)))
            fact.append((b in _REPORT) | (b in _SECOND) << 1 | w.isalpha() << 2)
        part = self.w[ids].reshape(-1, 4)
        own = np.empty((len(new), 6), dtype=np.float32)
        own[:, :4] = (part[:, 0] + part[:, 1])[:, None] + np.array(self.class_own, dtype=np.float32)[kind]
        own[:, 4:] = part[:, 2:]
        self.own = np.concatenate([self.own, own])
        self.hash = np.concatenate([self.hash, np.array(hashed, dtype=np.uint32)])
        self.kind = np.concatenate([self.kind, np.array(kind, dtype=np.int64)])
        self.fact = np.concatenate([self.fact, np.array(fact, dtype=np.uint8)])

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of tokens; they stay valid until the next call of ``renew``."""
        ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn()
        return ids

    def renew(self) -> None:
        if len(self.index) > 300_000:
            self._reset()

    def scores(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic-over-ok emission scores of all tokens of all sentences, given end to end, and the
        sentences' starts among the scores.

        Sentences are laid out with two markers before and one after each; the features of pairs are
        hashed for all of them at once.
        """
        m = len(size)
        before, after = self.numbers(["<", ">"])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        starts = first + 3 * np.arange(m) + 2
        lay = np.full(len(ids) + 3 * m, before, dtype=np.int64)
        lay[np.arange(len(ids)) + np.repeat(starts - first, size)] = ids
        lay[starts + size] = after
        h, k = self.hash[lay], self.kind[lay]
        f = np.bitwise_or.reduceat(self.fact[lay] & 3, starts - 2).astype(np.int64)
        out = self.own[lay, np.repeat(f, size + 3)]
        mask = np.uint32((1 << self.BITS) - 1)
        W = self.w
        out[1:] += self.own[lay[:-1], 4] + self.after[k[:-1], k[1:]] + W[mix(h[:-1], h[1:], _BEFORE) & mask]
        out[:-1] += self.own[lay[1:], 5] + self.before[k[:-1], k[1:]] + W[mix(h[:-1], h[1:], _AFTER) & mask]
        out[2:] += W[mix(h[:-2], h[2:], _TWO_BEFORE) & mask]
        return out, starts

    def marginals(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probability of toxic of all tokens of all sentences, given end to end, by forward-backward
        over padded batches."""
        every = np.zeros(len(ids), dtype=np.float32)
        if not len(ids):
            return every
        flat, st = self.scores(ids, size)
        at = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(-size, kind="stable")
        a = 0
        while a < len(order) and size[order[a]]:
            T = int(size[order[a]])
            b = min(len(order), a + max(1, 100_000 // T))
            b = a + int((size[order[a:b]] * 2 >= T).sum())
            group = order[a:b]
            n = size[group]
            t = np.arange(T)[:, None]
            inside = t < n[None, :]
            em = np.zeros((T, len(group), 2), dtype=np.float32)
            em[:, :, 1] = np.where(inside, flat[np.minimum(st[group][None, :] + t, len(flat) - 1)], 0.0)
            m = posterior(em, n, self.crf.trans, self.crf.start)[:, :, 1]
            every[(at[group][None, :] + t)[inside]] = m[inside]
            a = b
        return every

    def _reset(self) -> None:
        self.index = P._Numbers()
        self.own = np.zeros((0, 6), dtype=np.float32)
        self.hash = np.zeros(0, dtype=np.uint32)
        self.kind = np.zeros(0, dtype=np.int64)
        self.fact = np.zeros(0, dtype=np.uint8)
        self.classes: dict[str, int] = {}
        self.class_hash: list[int] = []
        self.class_own: list[list[float]] = []

    @property
    def w(self) -> np.ndarray:
        if self._w is None:
            self._w = np.ascontiguousarray(self.crf.w[:, 1] - self.crf.w[:, 0])
        return self._w

    def __getstate__(self) -> dict:
        return {"w": self.crf.w.astype(np.float32), "trans": self.crf.trans, "start": self.crf.start}

    def __setstate__(self, s: dict) -> None:
        self.__init__()
        self.crf.w, self.crf.trans, self.crf.start = s["w"], s["trans"], s["start"]


# Frames of tagged examples: <I>, <S>, <V>, <G> draw from the lexicons; fixed values.
TOXIC_FRAMES = """shut up you <I>|get out of here <I>|you are a <I> and a <I>|you are nothing but a <I>|go kill yourself <I>|i hope you die <I>|i will kill you|you should be dead you <I>
we will find you and <V> you|nobody likes you <I>|what a <I> you are|you <I> <I>|<I> go back to your hole|those <G> are <I>|all <G> are vermin and should be exterminated|<G> do not deserve to live
<G> are subhuman|keep those <G> out they are <I>|watch <S> <S> girls <S>|hot <S> <S> want to <S> you|free <S> videos of <S> <S>|she begged him to <S> her harder|he shoved his <S> inside her|<S> <S> live on cam
halt die fresse du <I>|verrecke du <I>|du bist ein <I>|ihr seid alle <I>|diese leute sind ungeziefer|nackte <S> vor der kamera|ferme ta gueule <I>|va crever <I>|tu es un <I>|ces gens sont de la vermine|filles <S> en direct
callate la boca <I>|ojala te mueras <I>|eres un <I>|esa gente es una plaga|chicas <S> en directo|cala a boca <I>|voce e um <I>|tomara que morra <I>|заткнись <I>|ты <I>|чтоб ты сдох <I>|你 这 个 白 痴|去 死 吧
fuck you|shut up|shut up !|just shut up you|you <I>|kill yourself|<I>|die you <I>|everyone here is a <I>|anyone who believes that is a <I> <I>|all of you are <I>|you must be a <I> to think so|they must be a <I> <I> to say this|去 死 吧 ！|你 去 死|你 去 死 吧 ！|你 是 个 白 痴|你 这 个 混 蛋|滚 开 ， 你 这 个 废 物|你 真 恶 心"""
CLEAN_FRAMES = """the moderators removed a post that called someone a <I>|the court convicted a man who shouted <I> at a guard|an essay explains why people were called <I>|the report on hate speech laws was discussed
the farmers shot the <I> that ate the corn|the <S> figure in the museum is carved from stone|sex education lessons start in year seven|the sex of each animal was recorded|breast cancer screening is offered to women
the cock crowed and the ass stood in the stable|the naked eye can see the planet|the script will kill the process and abort the child|this damn printer jammed again|what a stupid machine i thought|it was a hell of a day
the film shows a man who wants to kill the king|he died of a heart attack|researchers studied abuse and violence in schools|the war killed many people|kill the task if it hangs|a dead battery|the pig ate the corn
women and men voted|the immigrants arrived by train|the rat ran into the barn|trash is collected on monday|the dog is a bitch of four years|a group of volunteers cleaned the lighthouse|you can see the green frog by the pond
if you plan to visit the market arrive early|your order was shipped|das schwein frisst im stall|der hund ist tot|le porc est dans la ferme|la basura se recoge el lunes|el cerdo come maiz
thank you|thank you all|how are you|and you|see you soon|good for you|are you sure|can you help me|you are right|you are welcome|you did it|nice to meet you|hello|yes|no|what a mess
danke dir|und du|merci a vous|et toi|gracias a ti|y tu|obrigado a voce|спасибо тебе|как ты|谢 谢 你|你 好|你 好 吗|你 去 吗|这 个 人 死 了|他 去 年 去 世"""


def seed_sentences(n: int = 6, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Tagged sentences from the frames, some with disguised words."""
    rng = np.random.default_rng(seed)
    lex = {"<I>": INSULTS, "<S>": SEXUAL, "<V>": VIOLENT, "<G>": GROUPS}
    out = []
    for frames, tag in ((TOXIC_FRAMES, 1), (CLEAN_FRAMES, 0)):
        for frame in frames.replace("\n", "|").split("|"):
            for _ in range(n if "<" in frame else 2):
                ws = []
                for w in frame.split():
                    if w in lex:
                        w = str(rng.choice(lex[w]))
                        if tag and rng.random() < 0.25 and w.isascii() and len(w) > 3:
                            i = int(rng.integers(1, len(w) - 1))
                            w = (w[:i] + "*" + w[i + 1 :], w[:i] + "0" + w[i + 1 :], "-".join(w), ".".join(w))[int(rng.integers(4))]
                    ws.append(w)
                ws.append(".")
                out.append((ws, [tag] * len(ws)))
    for k in sorted(P.COMMON):
        for _ in range(25):
            ws = [str(w) for w in rng.choice(sorted(P.COMMON[k]), size=int(rng.integers(3, 25)))]
            out.append((ws, [0] * len(ws)))
    return out


def sentence_words(text: str) -> list[list[str]]:
    return [words_of(text[a:b]) for a, b in pieces(text)]


def _pairs(ws: list[str]) -> set[str]:
    b = [undisguise(w)[0] for w in ws]
    return {x + "_" + y for x, y in zip(b, b[1:])} | {x + "__" + y for x, y in zip(b, b[2:])}


def mine(toxic: list[str], clean: list[str]) -> list[tuple[list[str], list[int]]]:
    """Tag the sentences of rated documents by how word pairs split between the ratings."""
    ts = [[s for s in sentence_words(P.normalise(t)) if s] for t in toxic]
    cs = [[s for s in sentence_words(P.normalise(t)) if s] for t in clean]
    a: Counter = Counter()
    c: Counter = Counter()
    for d in ts:
        a.update(set().union(*map(_pairs, d)) if d else ())
    for d in cs:
        c.update(set().union(*map(_pairs, d)) if d else ())
    na, nc = max(1, len(ts)), max(1, len(cs))

    def odds(p: str) -> float:
        return np.log((a[p] + 0.1) / (na + 1)) - np.log((c[p] + 0.3) / (nc + 1))

    out = []
    for d in ts:
        for s in d:
            ps = [odds(p) if a[p] >= 3 else 0.0 for p in _pairs(s)]
            lex = sum(word_class(w)[0] in "ISV" or word_class(w).endswith("h") for w in s)
            strong = sum(v > 2.2 for v in ps)
            if ps and (strong >= max(2, 0.25 * len(ps)) or (lex >= 2 and strong >= 2)) and np.mean(ps) > 0.7:
                out.append((s, [1] * len(s)))
    # Clean sentences with words of the lexicons teach most; of the others every eighth is enough.
    k = 0
    for d in cs:
        for s in d:
            k += 1
            if k % 8 == 0 or any(word_class(w) != "-" for w in s):
                out.append((s, [0] * len(s)))
    return out


def train(docs: DataFrame, labels: DataFrame) -> Tagger:
    r = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("m")).where("m IN (0, 1)")
    t = docs.select("doc_id", "text").where("length(trim(text)) > 0")
    src = t.join(r, "doc_id").select("m", "text", F.xxhash64("doc_id").alias("h"))
    w = Window.partitionBy("m").orderBy("h")
    rows = src.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.when(F.col("m") == 1, TRAIN_ROWS).otherwise(CLEAN_ROWS)).select("m", "text", "h").collect()
    rows = sorted(rows, key=lambda x: (x.m, x.h))
    return fit([x.text for x in rows if x.m == 1], [x.text for x in rows if x.m == 0])


def fit(toxic: list[str], clean: list[str]) -> Tagger:
    return Tagger().fit(seed_sentences() + mine(toxic, clean))


def score_texts(texts: list[str | None], tagger: Tagger) -> list[tuple[float, list[dict]]]:
    """Document score and toxic spans (positions in the text as given) per text; every sentence with a
    letter is scored, however short."""
    tagger.renew()
    owner, where, flat, sizes, clean = [], [], [], [], []
    for i, t in enumerate(texts):
        t = P.normalise(t) if t and t.strip() else ""
        clean.append(t)
        spelled, masked = bool(_SPELL_HINT.search(t)), bool(_MASKED.search(t))
        find = None if spelled else _pattern(t, False, masked)
        low = t.lower()
        same = len(low) == len(t)
        for a, b in pieces(t):
            ws = find.findall(low, a, b) if find and same else words_of(t[a:b], spelled, masked)
            if ws:
                owner.append(i)
                where.append((a, b))
                sizes.append(len(ws))
                flat += ws
    out: list[tuple[float, list[dict]]] = [(0.0, []) for _ in texts]
    if not flat:
        return out
    ids, size = tagger.numbers(flat), np.array(sizes)
    every = tagger.marginals(ids, size)
    at = np.concatenate([[0], np.cumsum(size)])
    letters = np.bitwise_or.reduceat(tagger.fact[ids], at[:-1]) & 4 > 0
    mean = np.add.reduceat(every, at[:-1]) / size
    top = np.maximum.reduceat(every, at[:-1])
    best = np.zeros(len(texts))
    np.maximum.at(best, np.array(owner), np.where(letters & (top < THRESHOLD), mean, 0.0))
    spans: dict[int, list[dict]] = {}
    salad: dict[int, bool] = {}
    for j in np.flatnonzero(letters & (top >= THRESHOLD)).tolist():
        i, (a, b), v = owner[j], where[j], float(mean[j])
        m = every[at[j] : at[j + 1]]
        if v < THRESHOLD:
            v = max(v, _part_score(m, flat[at[j] : at[j + 1]]))
        if v >= THRESHOLD:
            if i not in salad:
                all_words = P.WORD.findall(clean[i].lower())
                salad[i] = P.misfits(all_words) > 0.04 * len(all_words)
            if salad[i]:
                continue
            sp = tokens(clean[i][a:b])
            on = np.flatnonzero(m >= THRESHOLD)
            if len(on) and len(sp) == len(m):
                spans.setdefault(i, []).append({"start_pos": a + sp[on[0]][0], "end_pos": a + sp[on[-1]][1], "score": v})
        best[i] = max(best[i], v)
    for i, xs in spans.items():
        back = P.normalise_map(texts[i])[1]
        for x in xs if back is not None else ():
            x["start_pos"], x["end_pos"] = back[x["start_pos"]], back[x["end_pos"]]
    return [(float(best[i]), spans.get(i, [])) for i in range(len(texts))]


def _part_score(m: np.ndarray, ws: list[str]) -> float:
    """The score of a sentence that is toxic in part: two or more words of the lexicons among the
    tagged, or a long tagged end, as where a heading runs into the sentence."""
    hot = np.flatnonzero(m >= THRESHOLD)
    if sum(word_class(ws[j])[0] in "ISV" for j in hot) >= 2:
        return float(np.sort(m)[-min(4, len(m)) :].mean())
    cold = np.flatnonzero(m < THRESHOLD)
    tail = m[cold[-1] + 1 :] if len(cold) else m
    if len(tail) >= 7 and 3 * len(tail) >= len(m):
        return float(tail.mean())
    return 0.0


def score(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    bm = docs.sparkSession.sparkContext.broadcast(tagger)
    kept: dict = {}

    def fn(ids: list, texts: list, *rest: list) -> list[list]:
        r = score_texts(texts, kept.setdefault("m", bm.value))
        return [ids, [x for x, _ in r], [s for _, s in r], *rest]

    types = dict(docs.dtypes)
    ddl = f"{id_col} {types[id_col]}, score double, spans array<struct<start_pos:long,end_pos:long,score:double>>" + "".join(f", {k} {types[k]}" for k in keep)
    return map_columns(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), *keep), ["_i", "_t", *keep], ddl, fn)


def rates(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Documents, toxic documents and rate per source."""
    return (
        score(docs, tagger, keep=("source",))
        .groupBy("source")
        .agg(F.count("*").alias("docs"), F.count_if(F.col("score") >= THRESHOLD).alias("toxic_docs"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("toxic_rate"))
    )


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    tagger = train(docs, labels)
    return score(docs.where("length(trim(text)) > 0"), tagger).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()
