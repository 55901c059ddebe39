"""Problem 1: per-document text statistics and the verdict prose or not.

A text is cut into units: runs of lines that end in sentence punctuation, with list, table, code,
log and noise lines set apart.  A unit is a running sentence if it is closed, mostly words, not a
chain of separators, and the units around it hold enough common words of some language.

Defined results: null or blank text has zero counts, a null verdict and the reason ``empty``; very
long texts are read whole; repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from siltworks.llm.batches import map_columns
from siltworks.llm.encoding import light_repair, repair_map

# Frequent function words by language; fixed values.
COMMON: dict[str, frozenset[str]] = {
    "en": frozenset("the of and to in a is that it was for on as with his he be at by i this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()),
    "fr": frozenset("le la les un une des du de et à au aux en dans par pour sur avec sans est sont était ont a été que qui quoi dont où ce cet cette ces il elle ils elles nous vous je tu on se sa son ses leur leurs mon ma mes ton ta tes notre votre ne pas plus mais ou donc car ni si comme très tout tous toute toutes bien aussi encore même après avant depuis pendant chez vers entre quand puis alors fait être avoir l d qu n s c j y peu deux".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ob wenn als wie in im an am auf aus bei mit nach von vom zu zum zur für über unter vor durch gegen ohne um bis seit ist sind war waren wird werden wurde hat haben hatte sein kann soll muss ich du er sie es wir ihr man sich nicht kein keine nur noch schon auch sehr mehr so da dann hier dort wer was wo diese dieser dieses jeder alle viele einige unsere mein dein ihre sei".split()),
    "es": frozenset("el la los las un una unos unas de del al a en por para con sin sobre entre hasta desde y e o u pero sino que quien cual cuando donde como porque aunque si no ni ya muy más menos es son era fue ha han hay está están ser se su sus mi tu nos lo le les me te este esta estos estas ese esa eso esto todo todos toda otra otro otras vez bien también después antes durante unos tres".split()),
    "pt": frozenset("o a os as um uma uns umas de do da dos das no na nos nas em ao aos à às por pelo pela para com sem sobre entre até desde e ou mas que quem qual quando onde como porque embora se não nem já muito mais menos é são era foi há está estão ser seu sua seus suas meu minha nos lhe me te este esta isto esse essa isso todo todos toda todas outra outro bem também depois antes durante ainda pois".split()),
    "ru": frozenset("и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой ним здесь этом один почти мой тем чтобы нее были куда зачем всех при два об хоть после над больше тот через эти нас про всего них много эта моей хотя очень".split()),
    "it": frozenset("il lo la i gli le un uno una di del della dei delle a al alla in nel nella da dal con su per tra fra e o ma che chi non è sono era ha hanno si se come più anche questo questa quello dove quando perché molto".split()),
    "nl": frozenset("de het een en van in op te dat die is was zijn voor met aan er niet als bij ook maar om dan door naar uit over wordt werd heeft hebben ik je hij zij we ze dit deze wat wie nog wel geen".split()),
}
_ALL_COMMON = frozenset().union(*COMMON.values())
_ZH_COMMON = frozenset("的了是在我有和不这也就人们来到他你一个上时会可以没很为因而从对被把后又吗呢吧啊还都去说看要能")

CJK = "㐀-鿿豈-﫿"
_CJK = re.compile(f"[{CJK}]")
_CJK_RUN = re.compile(f"[{CJK}]+")
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
# Ends of sentences: closing marks may follow; an abbreviation is handled by the caller.
_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？][”’」』]?")
_BULLET = re.compile(r"^\s*(?:[-*•·‣▪◦–—]|\(?\d{1,4}[.):,]|\(?[a-z][.)])\s+")
_TABLE = re.compile(r"\|.*\||\t|;[^;\n]*;|,[^,\n\s]*,[^,\n\s]*,|\S {3,}\S")
_CODE = re.compile(
    r"^\s*(?:def |class |import |from \S+ import|return\b.*[;:()\[\]]|if .*[:{(]$|if \(|for .*[:{(]$|for \(|while .*[:{]$|else\b.*[:{]|elif |try:|except|const |let |var |static |int |void |public |private |function\b|#include|package |use |fn |func |SELECT |FROM |WHERE |GROUP BY|ORDER BY|INSERT |UPDATE .* SET|CREATE |\}|\{|</?\w+[ >/]|[\w.\[\]\"']+\s*[:=]=?\s*[\[{\"'\d]|[\w.]+\(.*\)[;:]?$|\w+:\s*$)"
    r"|[;{}]\s*$|=>|->\s*\w+\s*[:{]|\w\(\w*\)\s*[;{.]"
)
_LOG = re.compile(r"^\s*(?:\d{9,}|\d{4}-\d\d-\d\d[T ]\d|\[\d|\d\d:\d\d:\d\d)\s*.*\b(?:WARN|ERR|ERROR|INFO|DBG|DEBUG|TRACE|FATAL|NOTICE|GET|POST|rc=|0x)")
# A line of words and ordinary punctuation only, as most lines of prose are.
_PLAIN = re.compile(r"[\"“‘«¿¡]?[^\W\d_][^{}\[\]<>=|\t;#*:_\\/+@()^~]*$")
_LETTERS = re.compile(r"[^\W\d_]+")
# Digits, separators other than commas, and signs: a sentence without any needs no count of them.
_SPECIAL = re.compile(r"[\d|;•/{}\[\]<>=_#^~\\+*@$%-]")
_NUMBER = re.compile(r"(?<!\w)\d")
_OPS = re.compile(r"[{}\[\]<>=_#^~\\+*/@$%]")
_ENDS = frozenset(".!?…。！？")
_ABBREV = re.compile(r"(?:^|[\s(])(?:[A-Z]|no|No|NO|nº|Mr|Mrs|Ms|Dr|Prof|St|Sr|Sra|Nr|M|Mme|Hr|Fr|vs|etc|ca|z\.B|e\.g|i\.e|Inc|Ltd|Co|Jr|tel|Tel|ext)\.$")


class Unit(NamedTuple):
    start: int
    end: int
    text: str
    words: int
    prose: bool
    low: list[str]  # the words in lower case


def closed(s: str) -> bool:
    """Whether a text ends in sentence punctuation, before closing marks and white space."""
    return s.rstrip().rstrip("\"'”’»)]」』")[-1:] in _ENDS


# As written in running text, at the start of a sentence and in capitals.
_CASED = frozenset(x for w in _ALL_COMMON for x in (w, w.capitalize(), w.upper()))
_is_common = _CASED.__contains__


def line_kind(line: str) -> str:
    """``blank, bullet, table, code, log, noise`` or ``flow``."""
    if _PLAIN.match(line) and "   " not in line and (" " in line or len(line) < 40):
        return "flow"
    s = line.strip()
    if not s:
        return "blank"
    if s[0] in "[0123456789" and _LOG.match(s):
        return "log"
    letters = sum(map(len, _LETTERS.findall(s)))
    if letters < 0.5 * len(s.replace(" ", "")):
        if _TABLE.search(line) and letters:
            return "table"
        if letters < 0.3 * len(s) or len(s) > 20:
            return "noise"
    if len(s) > 40 and " " not in s and not _CJK.search(s):
        return "noise"
    if _BULLET.match(line):
        return "bullet"
    if _CODE.search(line):
        return "code"
    if not closed(s) and _TABLE.search(line):
        return "table"
    return "flow"


_DASH_TALK = re.compile(r"^\s*[-–—]\s+[^\n]*[.!?]\s*$")
# Ends of sentences of texts without Chinese marks, and of texts in ASCII.
_END_LATIN = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)")
_END_ASCII = re.compile(r"[.!?][\"')\]]*(?=\s|$)")
_END_WIDE = re.compile("[。！？]")


def _ends(s: str) -> re.Pattern:
    return _END_ASCII if s.isascii() else _END if _END_WIDE.search(s) else _END_LATIN


def sentences(s: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a flow of text."""
    out, a, n = [], 0, len(s)
    for m in _ends(s).finditer(s):
        e = m.end()
        # Only a short last word can be an abbreviation.
        if e < n and s[e - 1] == "." and (" " in (tail := s[max(a, e - 6) : e]) or "(" in tail or "\n" in tail or e - a < 6) and _ABBREV.search(s[max(a, e - 8) : e]):
            continue
        out.append((a, e))
        a = e
    if a < n and not s[a:].isspace():
        out.append((a, n))
    return out


def count_words(s: str) -> int:
    """Words of a text; a run of Chinese characters counts two characters a word."""
    if s.isascii():
        return len(_ascii_words(s.lower()))
    cjk = sum(map(len, _CJK_RUN.findall(s)))
    return len(WORD.findall(_CJK_RUN.sub(" ", s) if cjk else s)) + (cjk + 1) // 2


# Joining marks that join nothing, and ASCII characters that stand in no word.
_STRAY = re.compile(r"(?<![a-z0-9])['\-]|['\-](?![a-z0-9])")
_BLANKED = str.maketrans({c: " " for c in map(chr, range(128)) if not (c.isalnum() or c in "'-")})


def _spaced(low: str) -> str:
    """A lower-case ASCII text, character for character, with blanks for all that is in no word."""
    if "'" in low or "-" in low:
        low = _STRAY.sub(" ", low)
    return low.translate(_BLANKED)


def _ascii_words(low: str) -> list[str]:
    return _spaced(low).split()


# Words that cannot stand side by side in English prose; fixed values.
_DETERMINERS = frozenset("the a an their my your our its his".split())
_AFTER_DETERMINER = frozenset("the a an of to in at for with from by and or but not if is was are were be been has have had can as so that this these those what which who we you he she it they there get out up about between against on their her our your my".split())
_PREPOSITIONS = frozenset("of at for with from by between against in on to about".split())
_AFTER_PREPOSITION = frozenset("is was are were has had can of and or but not if by with from as so who there at for".split())


class Vocabulary:
    """The words that a worker met, numbered in lower case, with facts of each.

    ``renew`` forgets all of them once there are more than ``most``; it is called between batches
    only, so that the numbers of one batch stay valid.
    """

    COMMON, DET, AFTER_DET, PREP, AFTER_PREP, ALPHA, WIDE, NUMBER = 1, 2, 4, 8, 16, 32, 64, 128

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.generation = 0
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.words = self.index.words
        self.flags = np.zeros(4096, dtype=np.uint8)
        self.size = np.zeros(4096, dtype=np.float32)
        self.done = 0

    def renew(self) -> None:
        if len(self.words) > self.most:
            self.generation += 1
            self._clear()

    def ids(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        n = len(self.words)
        if n > self.done:
            if n > len(self.flags):
                more = max(n, 2 * len(self.flags))
                self.flags, self.size = np.resize(self.flags, more), np.resize(self.size, more)
            for j in range(self.done, n):
                w = self.words[j]
                self.flags[j] = (
                    (w in _ALL_COMMON) | (w in _DETERMINERS) << 1 | (w in _AFTER_DETERMINER) << 2 | (w in _PREPOSITIONS) << 3
                    | (w in _AFTER_PREPOSITION) << 4 | w.isalpha() << 5 | bool(_CJK.search(w)) << 6 | w[0].isdigit() << 7
                )
                self.size[j] = len(w)
            self.done = n
        return out


class _Numbers(dict):
    """Words to numbers in the order of their first use."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self.words)
        self.words.append(w)
        return n


_VOCABULARY = Vocabulary()


class Segments(NamedTuple):
    """The sentences of a batch of texts in order, one array entry a sentence, and their words."""

    doc: np.ndarray  # the text's number in the batch
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray  # words, a run of Chinese characters as two characters a word
    prose: np.ndarray  # whether it is a running sentence
    at: np.ndarray  # where its words begin in ``ids``; one entry more than sentences
    ids: np.ndarray  # numbers of the words of all sentences in ``vocabulary``
    total: np.ndarray  # words of each text, those outside sentences too
    running: np.ndarray  # words of each text in running sentences
    other_doc: np.ndarray  # texts of the words outside sentences
    other_ids: np.ndarray
    vocabulary: Vocabulary

    @property
    def is_prose(self) -> np.ndarray:
        """Per text whether running sentences hold at least half of its words."""
        return (self.total > 0) & (2 * self.running >= self.total)


_ZH_MARKS = re.compile(f"[{''.join(sorted(_ZH_COMMON))}]")


def _add_up(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(by, weights=values, minlength=n)


def segment_all(texts: list[str], vocabulary: Vocabulary | None = None) -> Segments:
    """Cut a batch of texts into sentences with the verdict on each; list, table, code, log and noise
    lines hold no sentences.  Noise counts by the pieces between white space."""
    voc = vocabulary or _VOCABULARY
    voc.renew()
    flat: list[str] = []
    other: list[str] = []
    other_doc: list[int] = []
    doc, block_of, starts, ends, count, at, form, commons = [], [], [], [], [], [], [], []
    lowered: list[bool] = []
    total = np.zeros(len(texts))
    n_blocks = 0
    for d, text in enumerate(texts):
        blocks: list[tuple[int, int]] = []
        pos, start, last = 0, -1, 0
        extra = 0
        for line in text.split("\n"):
            size = len(line)
            if not line or line.isspace():
                if start >= 0:
                    blocks.append((start, last))
                    start = -1
                pos += size + 1
                continue
            k = "flow" if _PLAIN.match(line) and "   " not in line and (size < 40 or " " in line) else line_kind(line)
            if k != "flow":
                if k == "bullet":
                    if _DASH_TALK.match(line) and sum(map(_is_common, WORD.findall(line))) >= 2:
                        k = "flow"
                elif start >= 0 and k in ("table", "code") and closed(line) and sum(map(_is_common, WORD.findall(line))) >= 3:
                    k = "flow"
            if k == "flow":
                if start < 0:
                    start = pos
                last = pos + size
            else:
                if start >= 0:
                    blocks.append((start, last))
                    start = -1
                if k == "noise":
                    extra += len(line.split())
                else:
                    ws = _ascii_words(line.lower()) if line.isascii() else WORD.findall(line.lower())
                    cjk = 0 if line.isascii() else sum(map(len, _CJK_RUN.findall(line)))
                    extra += count_words(line) if cjk else len(ws)
                    other += ws
                    other_doc += [d] * len(ws)
            pos += size + 1
        if start >= 0:
            blocks.append((start, last))
        for a, b in blocks:
            flow = text[a:b]
            plain = flow.isascii()
            if plain:
                spaced = _spaced(flow.lower())
            special = _SPECIAL.search(flow) is not None
            for x, y in sentences(flow):
                s = flow[x:y]
                cjk = 0
                if plain:
                    low = spaced[x:y].split()
                elif s.isascii():
                    low = _ascii_words(s.lower())
                else:
                    low = WORD.findall(s.lower())
                    cjk = sum(map(len, _CJK_RUN.findall(s)))
                n = len(low)
                if cjk > 4:
                    n = count_words(s)
                    c = len(_ZH_MARKS.findall(s))
                    good = c * 40 >= cjk and closed(s)
                else:
                    c = -1
                    good = 3 <= n <= 160 and s.count(",") <= 0.22 * n + 1 and (y < b - a or closed(s))
                    if good and special and _SPECIAL.search(s):
                        good = (
                            n - len(_NUMBER.findall(s)) >= 0.7 * n
                            and sum(map(s.count, (",", "|", ";", " - ", "•", " / "))) <= 0.22 * n + 1
                            and len(_OPS.findall(s)) <= 0.04 * len(s) + 1
                        )
                doc.append(d)
                block_of.append(n_blocks)
                starts.append(a + x)
                ends.append(a + y)
                count.append(n)
                at.append(len(flat))
                form.append(good)
                commons.append(c)
                lowered.append(s.lstrip()[:1].islower())
                flat += low
            n_blocks += 1
        total[d] = extra
    ids = voc.ids(flat)
    other_ids = voc.ids(other)
    m = len(doc)
    doc_, block, words, form_ = np.array(doc, dtype=np.int64), np.array(block_of, dtype=np.int64), np.array(count, dtype=np.int64), np.array(form, dtype=bool)
    at_ = np.array([*at, len(flat)], dtype=np.int64)
    size = np.diff(at_)
    owner = np.repeat(np.arange(m), size)
    flags = voc.flags[ids]
    given = np.array(commons, dtype=np.float64)
    common = np.where(given >= 0, given, np.where(size < 2, 0, _add_up(flags & voc.COMMON, owner, m)))
    # Pairs of words in which an English closed-class word is followed by one that cannot follow it, or
    # a word by itself; strings of random common words are full of them.
    bad = np.zeros(m)
    if len(ids) > 1:
        f, g = flags[:-1], flags[1:]
        pair = ((f & voc.DET > 0) & (g & voc.AFTER_DET > 0) | (f & voc.PREP > 0) & (g & voc.AFTER_PREP > 0)).astype(np.int64) + (ids[:-1] == ids[1:])
        pair[owner[:-1] != owner[1:]] = 0
        bad = np.where((given < 0) & (common > 0.55 * size), _add_up(pair, owner[:-1], m), 0)
    b_words = _add_up(words, block, n_blocks)
    b_total = _add_up(words * form_, block, n_blocks)
    b_common = _add_up(common * form_, block, n_blocks)
    b_lower = _add_up(words * np.array(lowered, dtype=bool), block, n_blocks)
    ok = (b_total > 0) & (b_common >= 0.12 * b_total) & (_add_up(bad, block, n_blocks) < np.where(2 * b_lower > b_words, 0.05, 0.12) * b_words)
    prose = ok[block] & form_ & ((common > 0) | (words >= 4)) if m else form_
    total += _add_up(words, doc_, len(texts))
    running = _add_up(words * prose, doc_, len(texts))
    return Segments(doc_, np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), words, prose, at_, ids, total, running, np.array(other_doc, dtype=np.int64), other_ids, voc)


def misfits(low: list[str]) -> int:
    """Pairs of lower-case words that cannot stand side by side, or a word twice."""
    _VOCABULARY.renew()
    ids = _VOCABULARY.ids(low)
    f = _VOCABULARY.flags[ids]
    f, g = f[:-1], f[1:]
    v = Vocabulary
    return int(((f & v.DET > 0) & (g & v.AFTER_DET > 0) | (f & v.PREP > 0) & (g & v.AFTER_PREP > 0)).sum() + (ids[:-1] == ids[1:]).sum())


def units(text: str) -> list[Unit]:
    """The sentences of one text."""
    s = segment_all([text])
    w = s.vocabulary.words
    return [
        Unit(int(a), int(b), text[a:b], int(n), bool(p), [w[j] for j in s.ids[i:k]])
        for a, b, n, p, i, k in zip(s.start, s.end, s.words, s.prose, s.at[:-1], s.at[1:])
    ]


def prose_share(text: str) -> tuple[int, int]:
    """Words in running sentences, and all words."""
    s = segment_all([text])
    return int(s.running[0]), int(s.total[0])


def normalise(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() and "&#" not in text else light_repair(text)


def normalise_map(text: str) -> tuple[str, list[int] | None]:
    """The normalised text, and for each of its positions (its end too) that of the text as given;
    None where they are the same."""
    back: list[int] | None = None
    if "\r" in text:
        back = [i for i, c in enumerate(text) if c != "\r" or text[i + 1 : i + 2] != "\n"]
        back.append(len(text))
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    clean, repaired = repair_map(text)
    if repaired is not None:
        back = repaired if back is None else [back[i] for i in repaired]
    return clean, back


def is_prose(text: str) -> bool:
    p, n = prose_share(normalise(text))
    return 2 * p >= n and n > 0


# Published fixed thresholds for web text (heuristic quality rules of large text corpora).
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN, MAX_MEAN = 3.0, 10.0
MAX_SYMBOLS, MAX_BULLETS, MAX_ELLIPSIS = 0.1, 0.9, 0.3
MIN_ALPHA, MIN_COMMON, MIN_PUNCT, MIN_PROSE = 0.8, 0.06, 0.1, 0.5

SCHEMA = (
    "n_chars long, n_words long, mean_word_len double, symbol_ratio double, punct_line_share double, "
    "bullet_line_share double, ellipsis_line_share double, common_word_share double, alpha_word_share double, "
    "prose_share double, is_prose boolean, reasons array<string>"
)
_SYMBOLS = "#{}[]<>=_^~\\|+*/@$%"
_BOXES = re.compile("[─-◿]")


def stats(texts: list[str | None]) -> list[list]:
    """Columns of ``SCHEMA`` for a batch of texts: counts over lines and over numbered words of the
    whole batch, then the fixed thresholds on whole columns.  Words of noise lines count by pieces,
    and are neither common nor alphabetic."""
    clean = [normalise(t) if t and t.strip() else "" for t in texts]
    k = len(texts)
    seg = segment_all(clean)
    line_of, ends, bullets, dots = [], [], [], []
    symbols = np.zeros(k)
    marks = np.zeros(k)
    for d, t in enumerate(clean):
        if not t:
            continue
        symbols[d] = sum(map(t.count, _SYMBOLS)) + (0 if t.isascii() else len(_BOXES.findall(t)))
        marks[d] = 0 if t.isascii() or not _CJK.search(t) else len(_ZH_MARKS.findall(t))
        for x in t.split("\n"):
            x = x.rstrip()
            if x:
                line_of.append(d)
                ends.append(closed(x))
                bullets.append(_BULLET.match(x) is not None)
                dots.append(x.endswith(("...", "…")))
    line = np.array(line_of, dtype=np.int64)
    lines = np.maximum(_add_up(np.ones(len(line)), line, k), 1)
    voc = seg.vocabulary
    owner = np.concatenate([np.repeat(seg.doc, np.diff(seg.at)), seg.other_doc])
    ids = np.concatenate([seg.ids, seg.other_ids])
    flags = voc.flags[ids]
    latin = flags & voc.WIDE == 0
    n = seg.total
    latin_words = _add_up(latin, owner, k)
    cjk = np.maximum(n - latin_words, 0)
    safe = np.maximum(n, 1)
    mean = _add_up(voc.size[ids] * latin, owner, k) / np.maximum(latin_words, 1)
    common = (_add_up((flags & voc.COMMON > 0) & latin, owner, k) + marks) / safe
    wide = _add_up(flags & voc.WIDE > 0, owner, k) > 0
    alpha = (_add_up((flags & voc.ALPHA > 0) & latin, owner, k) + cjk * wide) / safe
    symbol = symbols / np.maximum([len(t) for t in clean], 1)
    punct, bullet, dot = (_add_up(np.array(x, dtype=bool), line, k) / lines for x in (ends, bullets, dots))
    share = seg.running / safe
    empty = np.array([not t for t in clean])
    rules = {
        "few_words": n < MIN_WORDS,
        "many_words": n > MAX_WORDS,
        "word_length": (latin_words > cjk * wide) & ((mean < MIN_MEAN) | (mean > MAX_MEAN)),
        "symbols": symbol > MAX_SYMBOLS,
        "bullets": bullet > MAX_BULLETS,
        "ellipsis": dot > MAX_ELLIPSIS,
        "alphabetic": alpha < MIN_ALPHA,
        "common_words": common < MIN_COMMON,
        "unpunctuated": punct < MIN_PUNCT,
        "no_running_text": ~seg.is_prose,
    }
    why: list[list[str]] = [["empty"] if e else [] for e in empty]
    for name, bad in rules.items():
        for d in np.flatnonzero(bad & ~empty):
            why[d].append(name)
    verdict = [None if e else not bad for e, bad in zip(empty, rules["no_running_text"])]
    numbers = [np.where(empty, 0.0, x).tolist() for x in (mean, symbol, punct, bullet, dot, common, alpha, share)]
    return [[len(t or "") for t in texts], n.astype(np.int64).tolist(), *numbers, verdict, why]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics, verdict and reasons per input row."""

    def fn(ids: list, texts: list) -> list[list]:
        return [ids, *stats(texts)]

    id_type = dict(docs.dtypes)[id_col]
    return map_columns(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), ["_i", "_t"], f"{id_col} {id_type}, {SCHEMA}", fn)


def found(docs: DataFrame) -> DataFrame:
    """Documents of which less than half of the words stand in running sentences."""

    src = docs.where("length(trim(text)) > 0")
    return text_stats(src).where("NOT is_prose").select("doc_id").distinct()
