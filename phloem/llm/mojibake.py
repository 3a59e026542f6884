"""Text garbled by a wrong character encoding: detection and repair by encode-decode chains under a character model."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phloem.llm.charlm import BUCKETS, CharModel, ngram_counts, word_table

#: Code pages that UTF-8 text is taken for. Names of Python codecs.
CODE_PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp866", "cp1258", "koi8_r", "iso8859_15", "cp874", "cp1253")

#: The single-byte Vietnamese code of TCVN 5712 (VN3), as its bytes look in the Western code page.
_TCVN_SEEN = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉË®ÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô­õøö÷ùúýûüþ¡¢§£¤¥¦"
_TCVN_MEANT = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵĂÂĐÊÔƠƯ"

#: The two-byte Vietnamese code VNI: letters of their own, and marks that follow a vowel.
_VNI_LETTERS = dict(zip("ñöôíìæóòîÑÖÔÍÌÆÓÒÎ", "đươíìỉĩịỵĐƯƠÍÌỈĨỊỴ"))
_VNI_MARKS = {
    "ù": "́", "ø": "̀", "û": "̉", "õ": "̃", "ï": "̣", "â": "̂", "á": "̂́", "à": "̂̀",
    "å": "̂̉", "ã": "̂̃", "ä": "̣̂", "ê": "̆", "é": "̆́", "è": "̆̀",
    "ú": "̆̉", "ü": "̆̃", "ë": "̣̆",
}
_VNI_MARKS |= {k.upper(): v for k, v in _VNI_MARKS.items()}
_TCVN = str.maketrans(_TCVN_SEEN, _TCVN_MEANT)

LOST = "�"


def split(text: str) -> list[str]:
    """The text between blanks, tabs and line ends; empty strings stand between two of them."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


_WORD = re.compile(r"[^ \t\r\n]+")
_HOLE = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
#: Margins tried on the records, in nats.
MARGINS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
#: Parts of the records, by hash of the text: the margin is tried on each part under the model of the others.
FOLDS = 4


def _byte_map(page: str) -> dict[int, int]:
    """Character -> byte of a code page; a control that the page leaves undefined stays the byte of its number."""
    known = {ord(c): b for b in range(256) if len(c := bytes([b]).decode(page, "ignore")) == 1}
    return {c: c for c in range(0x80, 0xA0)} | known


_BYTES = {page: _byte_map(page) for page in CODE_PAGES}


def from_utf8(page: str) -> Callable[[str], str | None]:
    table = _BYTES[page]

    def chain(word: str) -> str | None:
        try:
            return codecs.charmap_encode(word, "strict", table)[0].decode("utf-8")
        except UnicodeError:
            return None

    return chain


def from_cp1258(word: str) -> str | None:
    try:
        return codecs.charmap_encode(word, "strict", _BYTES["cp1252"])[0].decode("cp1258", "ignore")
    except UnicodeError:
        return None


def from_tcvn(word: str) -> str | None:
    return word.translate(_TCVN)


def from_vni(word: str) -> str | None:
    out: list[str] = []
    for ch in word:
        if ch in _VNI_MARKS and out and unicodedata.normalize("NFD", out[-1])[0] in "aeouyAEOUY" and len(unicodedata.normalize("NFD", out[-1])) < 3:
            out[-1] = unicodedata.normalize("NFC", out[-1] + _VNI_MARKS[ch])
        else:
            out.append(_VNI_LETTERS.get(ch, ch))
    return "".join(out)


def legacy() -> dict[str, Callable[[str], str | None]]:
    return {"tcvn": from_tcvn, "vni": from_vni, "cp1258<cp1252": from_cp1258}


def undone(word: str, firsts: dict[str, Callable], seconds: dict[str, Callable]) -> Iterator[tuple[str, str]]:
    """(chain, what it makes of the word) of every candidate chain that applies: one wrong decoding undone, or two.

    Two are every ordered pair of ``firsts`` and ``seconds``; a second one is tried where the first changed the word.
    """
    again: dict[str, list[tuple[str, str]]] = {}
    for name, chain in firsts.items():
        once = chain(word)
        if once is None:
            continue
        yield name, once
        if once == word or once.isascii():
            continue
        if once not in again:
            again[once] = [(second, twice) for second, f in seconds.items() if (twice := f(once)) is not None and twice != once]
        yield from ((f"{second}<{name}", twice) for second, twice in again[once])


_UTF8 = {f"utf8<{p}": from_utf8(p) for p in CODE_PAGES}
_LEGACY = legacy()
_ALL = _UTF8 | _LEGACY


@lru_cache(1 << 15)
def restorations(word: str) -> list[tuple[str, str]]:
    """(chain, what it makes of the word, in composed form) of each chain that applies and loses nothing."""
    known = {name: made for name, made in undone(word, _UTF8, _ALL) if LOST not in made}
    known |= {name: made for name, chain in _LEGACY.items() if (made := chain(word)) is not None and LOST not in made}
    return [(name, unicodedata.normalize("NFC", made)) for name, made in known.items()]


class Repairer:
    """Finds damaged runs of words and the chain that most likely restores each.

    Words are separated by blanks, tabs and line ends. A word's gain under a chain is the log-odds of what the chain
    makes of it against the word as it stands, both in composed form. Runs are found by Viterbi over the states 'as it
    stands' and one a chain, with a cost for each change of state; a run is accepted if its gain beats ``margin``.
    At most ``held`` words are kept with their options, whatever the texts.
    """

    def __init__(self, counts: np.ndarray, margin: float, switch: float = 3.0, held: int = 200_000):
        self.model, self.margin, self.switch, self.held = CharModel(counts, held=held), margin, switch, held
        self._words: dict[str, dict[str, tuple[float, str]]] = {}
        self._fine: set[str] = set()

    def options(self, word: str) -> dict[str, tuple[float, str]]:
        """Of a word: gain and result of each chain that applies."""
        known = self._words.get(word)
        if known is None:
            known, plain, scores = {}, None, {}
            made_of = restorations(word) if len(word) < 64 else restorations.__wrapped__(word)
            holes = _HOLE.search(word)
            if made_of or holes:
                plain = self.model.score(unicodedata.normalize("NFC", word))
            for name, made in made_of:
                if made not in scores:
                    scores[made] = 0.0 if made == word else self.model.score(made) - plain
                known[name] = (scores[made], made)
            if holes:
                known["hole"] = (self._filled(word, holes.start()) - plain, word)
            if len(self._words) < self.held and len(word) < 64:
                self._words[word] = known
        return known

    def suspects(self, words: set[str]) -> set[str]:
        """The words that a chain gains on, and those with lost characters. Without any, no run can beat a margin."""
        fine, found = self._fine, set()
        for word in words - fine:
            if word.isascii() and "?" not in word:
                continue
            if LOST in word or any(gain > 0 for gain, _ in self.options(word).values()):
                found.add(word)
            elif len(fine) < self.held and len(word) < 64:
                fine.add(word)
        return found

    def _filled(self, word: str, at: int) -> float:
        """The best score that some letter instead of the question mark reaches."""
        return max(self.model.score(f"{word[:at]}{c}{word[at + 1 :]}") for c in "ạảấầẩậắằặẹẻếềểệịỉọỏốồổộớờởợụủứừửữựàáâãèéêìíòóôõùúýăđơưia")

    def stretches(self, words: list[str], suspects: set[str]) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, chain, gain) of the runs on the best path whose gain beats the margin.

        A chain that gains nowhere is on no best path, and none need begin at a word that it does not gain on unless it
        follows another chain. So the search goes from a suspect to where no chain stands above a fresh start, and on
        from the next suspect.
        """
        useful = {name for word in suspects for name, (gain, _) in self.options(word).items() if gain > 0}
        gains: dict[str, list[tuple[str, float]]] = {}
        never, out, done = float("-inf"), [], 0
        for begin in [i for i, word in enumerate(words) if word in suspects]:
            if begin < done:
                continue
            states, trail, done = {"": 0.0}, [], begin
            while done < len(words) and (len(states) > 1 or done == begin):
                word = words[done]
                done += 1
                if word.isascii() and "?" not in word:
                    trail.append(None)  # every state goes on
                    continue
                options = gains.get(word)
                if options is None:
                    options = gains[word] = [("", 0.0), *((k, g) for k, (g, _) in self.options(word).items() if k in useful)]
                best = max(states, key=states.__getitem__)
                move = states[best] - self.switch
                following, back = {}, {}
                for name, gain in options:
                    stay = states.get(name, never)
                    back[name] = name if stay >= move else best
                    following[name] = (stay if stay >= move else move) + gain
                fresh = following[""] - self.switch
                states = {name: value for name, value in following.items() if value > fresh}
                trail.append(back)
            state = max(states, key=states.__getitem__)
            path = []
            for back in reversed(trail):
                path.append(state)
                state = state if back is None else back[state]
            path.reverse()
            at = begin
            while at < done:
                first, name, gain = at, path[at - begin], 0.0
                while at < done and path[at - begin] == name:
                    if name and (not words[at].isascii() or "?" in words[at]):
                        gain += self.options(words[at]).get(name, (0.0,))[0]
                    at += 1
                if name and gain > self.margin:
                    out.append((first, at, name, gain))
        return out

    def runs(self, text: str) -> list[tuple[int, int, str, float, str]]:
        """Damaged runs: (start, end, chain, gain, restored text). Chain 'lost' means that characters are gone for good."""
        suspects = self.suspects(set(split(text)))
        if not suspects:
            return []
        places = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
        out = [(start, end, "lost", float("inf"), word) for start, end, word in places if LOST in word]
        for first, after, name, gain in self.stretches([word for _, _, word in places], suspects):
            pieces, at = [], places[first][0]
            for start, end, word in places[first:after]:
                option = None if word.isascii() and "?" not in word else self.options(word).get(name)
                pieces += [text[at:start], option[1] if option else word]
                at = end
            out.append((places[first][0], at, "lost" if name == "hole" else name, gain, "".join(pieces)))
        return sorted(out)

    def best_gain(self, words: list[str], suspects: set[str]) -> float:
        """The largest gain of a run of words without lost characters, 0 without any."""
        return max((gain for _, _, _, gain in self.stretches(words, suspects)), default=0.0) if suspects else 0.0


_UNCLEAN = re.compile("[\x80-\x9f─-▟�]")


class CleanReader:
    """Words of a text that looks clean, none of one that does not: a rough guard for training rows.

    Not clean are lost characters, C1 controls, box drawings, question marks inside words, and words that are UTF-8 in
    any of the code pages.
    """

    def __init__(self):
        self._pages, self._fine = [from_utf8(p) for p in CODE_PAGES], set()

    def clean(self, text: str, words: set[str]) -> bool:
        if _UNCLEAN.search(text) or ("?" in text and _HOLE.search(text)):
            return False
        for word in words - self._fine:
            if not word.isascii() and any(chain(word) not in (None, word) for chain in self._pages):
                return False
            if len(self._fine) < 500_000 and len(word) < 64:
                self._fine.add(word)
        return True

    def __call__(self, text: str) -> list[str]:
        words = split(text)
        return words if self.clean(text, set(words)) else []


def looks_clean(text: str) -> bool:
    return bool(CleanReader()(text))


#: What the bytes of a wrong decoding look like; a byte that the page leaves undefined is the control of its number.
_SEEN = [[bytes([b]).decode(page, "replace").replace(LOST, chr(b)) for b in range(256)] for page in CODE_PAGES]


def _spoilt(words: list[str], seed: int) -> tuple[int, list[str]] | None:
    """Place and garbled form of a word with accents, or of two neighbouring ones where there are, by one of the wrong decodings; None without any."""
    at = [i for i, plain in enumerate(map(str.isascii, words)) if not plain]
    if not at:
        return None
    pairs = [i for i, j in zip(at, at[1:]) if j == i + 1] if seed % 2 else []
    n, at = (2, pairs) if pairs else (1, at)
    i, page = at[seed % len(at)], _SEEN[seed // 2 % len(CODE_PAGES)]
    return i, ["".join([page[b] for b in unicodedata.normalize("NFC", w).encode("utf-8")]) for w in words[i : i + n]]


def tried_gains(repairer: Repairer, words: list[str], distinct: set[str], seed: int) -> tuple[float, float | None]:
    """Best gain of a text's words as they stand and of them with some garbled, None if none can be."""
    suspects = repairer.suspects(distinct)
    clean, spoilt = repairer.best_gain(words, suspects), _spoilt(words, seed)
    if spoilt is None:
        return clean, None
    i, made = spoilt
    return clean, repairer.best_gain(words[:i] + made + words[i + len(made) :], suspects | repairer.suspects(set(made)))


def best_margin(spoilt: list[int], clean: list[int], n_spoilt: int, n_clean: int) -> tuple[float, float, float]:
    """(margin, recall of garbled records, share of clean ones accepted) that does best, of the records accepted at each margin; the middle one of equal ones."""
    rates = [(s / n_spoilt if n_spoilt else 1.0, c / n_clean if n_clean else 0.0, m) for s, c, m in zip(spoilt, clean, MARGINS)]
    most = max(r - f for r, f, _ in rates)
    tied = [x for x in rates if x[0] - x[1] > most - 1e-9]
    recall, false, margin = tied[len(tied) // 2]
    return margin, recall, false


def validated_margin(texts: DataFrame, counts: np.ndarray) -> tuple[float, float, float]:
    """``best_margin`` over all rows of (mark, fold, text) that look clean, each under the counts of the other folds."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, repairers, total = CleanReader(), {}, shared.value.sum(axis=0, dtype=float)
        margins, tally = np.array(MARGINS), np.zeros((2, 1 + len(MARGINS)), dtype=np.int64)
        for batch in batches:
            for mark, fold, text in batch.itertuples(index=False, name=None):
                words = split(text)
                distinct = set(words)
                if not read.clean(text, distinct):
                    continue
                if fold not in repairers:
                    repairers[fold] = Repairer((total - shared.value[fold]).astype(np.float32), 0.0, held=200_000 // FOLDS)
                for row, gain in zip(tally, tried_gains(repairers[fold], words, distinct, mark // FOLDS)):
                    if gain is not None:
                        row[0] += 1
                        row[1:] += gain > margins
        yield pd.DataFrame(tally, columns=columns).assign(kind=["clean", "spoilt"])

    columns = ["n", *[f"m{i}" for i in range(len(MARGINS))]]
    tried = texts.mapInPandas(judge, ", ".join([*[f"{c} long" for c in columns], "kind string"]))
    got = {kind: (n, each) for kind, n, *each in tried.groupBy("kind").agg(*[F.sum(c) for c in columns]).collect()}
    (n_clean, clean), (n_spoilt, spoilt) = (got.get(kind, (0, [0] * len(MARGINS))) for kind in ("clean", "spoilt"))
    return best_margin(spoilt, clean, n_spoilt, n_clean)


def fitted(docs: DataFrame, text: str) -> tuple[np.ndarray, tuple[float, float, float]]:
    """The counts of all records that look clean, and ``validated_margin`` on all of them."""
    texts = docs.select(F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)
    texts = texts.select(F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("mark"), "text").select("mark", (F.col("mark") % FOLDS).cast("int").alias("fold"), "text")
    counts = ngram_counts(word_table(texts, CleanReader, FOLDS), folds=FOLDS).reshape(FOLDS, BUCKETS)
    return counts.sum(axis=0, dtype=float).astype(np.float32), validated_margin(texts, counts)


def validation(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: the margin, the share of garbled records that it accepts, and the share of clean-looking ones."""
    margin, recall, false = fitted(docs, text)[1]
    return docs.sparkSession.createDataFrame([(margin, recall, false)], "margin double, recall double, false_share double")


def repairs(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, restored, n_runs, n_lost, gain) of the documents whose text holds a garbled sequence.

    The character model counts all n-grams of all records that look clean. The margin is the one that does best on all
    of those, as they stand and with words garbled on purpose; each is judged by the counts of the FOLDS - 1 parts (by
    hash of the text) that it is not in. Every text is read whole. restored is the text with each accepted run replaced
    by what its chain makes of it; runs in which characters are gone for good (replacement characters, question marks
    inside words) are counted in n_lost and stay as they are. Null, blank and undamaged texts give no row, repeated rows
    one row each, an empty table none. Only n-gram counts (at most charlm.BUCKETS a part) and sums of accepted records
    reach the driver.
    """
    spark = docs.sparkSession
    counts, (margin, _, _) = fitted(docs, text)
    shared = spark.sparkContext.broadcast(counts)

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value, margin)
        for batch in batches:
            rows = []
            for key, body in batch.itertuples(index=False, name=None):
                found = repairer.runs(body)
                if not found:
                    continue
                out, at = [], 0
                for start, end, name, _, made in found:
                    if start < at:
                        continue
                    out += [body[at:start], body[start:end] if name == "lost" else made]
                    at = end
                rows.append((key, "".join(out) + body[at:], len(found), sum(r[2] == "lost" for r in found), min(max(r[3] for r in found), 1e6)))
            yield pd.DataFrame(rows, columns=["id", "restored", "n_runs", "n_lost", "gain"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)
    return rows.mapInPandas(repair, f"id {kind}, restored string, n_runs int, n_lost int, gain double").withColumnRenamed("id", id_col)
