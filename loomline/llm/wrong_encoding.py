"""Text decoded with the wrong character encoding: find it and restore it.

A multinomial classifier on hashed byte bigrams is trained on records garbled here by
known chains of encodings. It sees each run of characters beyond ASCII with its
neighbours, and names the chain that made it, or none; of the chains, only those count that
could have made it, byte for byte. The chain named is inverted, once, and verified: the result
must be strictly decodable, give the run again, hold plausible characters and read better than
before. If the runs of one text are given to several chains, they are judged together, and the
chain with the highest sum takes all runs that it could have made. UTF-8 that was misread
again and again is taken back to its last layer; a restored text is judged again until nothing
changes. Replacement characters are damage by definition and are found but not restored.

Defined results: null, empty and ASCII texts are clean. Every row with damage gives one row; a
repeated id is judged by each of its texts. Very long texts are judged whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chains of (right encoding, wrong encoding) pairs, in the order in which they were applied.
_UTF8_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "iso8859_15")
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    **{f"utf_8>{w}": (("utf_8", w),) for w in _UTF8_AS},
    **{f"utf_8>{v}>utf_8>{w}": (("utf_8", v), ("utf_8", w)) for v in ("cp1252", "latin_1") for w in ("cp1252", "latin_1")},
    **{f"cp1252>{w}": (("cp1252", w),) for w in ("mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859_7", "koi8_r")},
    **{f"{r}>cp1252": ((r, "cp1252"),) for r in ("mac_roman", "cp850", "cp437")},
}
#: Chain whose result was put in lower case afterwards.
LOWERED = "utf_8>cp1252>lower"
REPLACED = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
# First and last of the letters of a script.
SCRIPTS = ((0x3B1, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x915, 0x939), (0xE01, 0xE2E), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Hash buckets of byte bigrams.
BUCKETS = 1 << 16
#: Classes of the model: no damage, and each chain.
NAMES = ("", *CHAINS, LOWERED)
#: Tasks that count bigrams have at most this many; each sends on at most a table of classes and buckets.
COUNT_TASKS = 64
#: By how many nats a restored run must read better: after chains that end in strict UTF-8, after the others, and for signs without a letter beside them.
GAIN_UTF8, GAIN_OTHER, GAIN_ALONE = 0.0, 9.0, 15.0


def encode(text: str, codec: str) -> bytes | None:
    """Strict bytes of ``text``; bytes that a code page leaves undefined are the control characters of that number."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(codec)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) < 0xA0 or bytes([ord(c)]).decode(codec, "ignore"):
                    return None
                out.append(ord(c))
        return bytes(out)


def decode(data: bytes, codec: str) -> str | None:
    """Strict text of ``data``, with the same exception."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        if codec == "utf_8":
            return None
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data)


def garble(text: str, chain: str) -> str | None:
    """What the chain makes of a text; null if the text cannot go through it."""
    for right, wrong in (("utf_8", "cp1252"),) if chain == LOWERED else CHAINS[chain]:
        if (data := encode(text, right)) is None or (text := decode(data, wrong)) is None:
            return None
    return text.lower() if chain == LOWERED else text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, if every step back is strictly possible."""
    if chain == LOWERED:
        text, chain = "".join(c.upper() if c.upper() in "ÃÂÅÄÈÊÎÏÆØÐÑ" else c for c in text), "utf_8>cp1252"
    for right, wrong in reversed(CHAINS[chain]):
        if (data := encode(text, wrong)) is None or (text := decode(data, right)) is None:
            return None
    return text


def windows(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run with up to two characters on either side) of each run beyond ASCII."""
    for m in _RUN.finditer(text):
        i, j = m.span()
        yield i, j, text[max(0, i - 2) : i] + "\x02" + text[i:j] + "\x03" + text[j : j + 2]


def _features(window: str) -> np.ndarray:
    """Hashed bigrams of bytes, also over one or two bytes left out, that tell a character with its neighbours."""
    b = np.frombuffer(window.encode("utf_8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    c = b[(b != 2) & (b != 3)]
    return np.concatenate([b[:-1] * 257 + b[1:], c[:-2] * 257 + c[2:] + 70_001, c[:-3] * 257 + c[3:] + 140_009]) * 2654435761 % (1 << 32) >> 16


def _letters(left: str, run: str, right: str) -> np.ndarray:
    """Hashed bigrams of whole characters around and in the run, also over one character left out."""
    c = np.array([ord(x) for x in "\x02" * (2 - len(left)) + left + run + right + "\x03" * (2 - len(right))], dtype=np.int64)
    near, apart = (c[1:-2] * 1114129 + c[2:-1]) * 2654435761 >> 7, (c[:-2] * 1114129 + c[2:] + 77) * 2246822519 >> 7
    return np.concatenate([near, apart]) % BUCKETS


def script(char: str) -> str:
    """The script of a letter by the first word of its name; the scripts of Japanese and Chinese are one."""
    word = unicodedata.name(char, "?").split()[0]
    return "CJK" if word in ("HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH") else word


class Model:
    """Log-probabilities of hashed byte bigrams for no damage (row 0) and for each chain, and of character bigrams of clean text."""

    def __init__(self, log_p: np.ndarray, names: list[str], log_c: np.ndarray, known: frozenset[str]):
        self.log_p, self.names, self.log_c, self.known = log_p, names, log_c, known
        # the windows of a corpus repeat, so a worker remembers what it found
        self.judge = lru_cache(200_000)(self._judge)
        self.scores = lru_cache(50_000)(self._scores)
        self.unwind = lru_cache(500_000)(self._unwind)
        self.by_chain = lru_cache(200_000)(self._by_chain)

    def _scores(self, window: str) -> np.ndarray:
        return self.log_p[:, _features(window)].sum(axis=1)

    def _judge(self, window: str) -> tuple[str | None, str | None]:
        """(chain or None, restored run or None) of one window."""
        left, run, right = _parts(window)
        if REPLACED in run:
            return "replaced", None
        for c in np.argsort(-self.scores(window)):
            if c == 0:
                break
            back = self.unwind(window, self.names[c])
            if back is not None:  # the class predicted among those that could have made the run
                return (self.names[c], back) if self.better(left, run, right, back, self.names[c]) else (None, None)
        return None, None

    def plausible(self, text: str, strict: bool) -> bool:
        """Whether the characters are in use, or come out of strict UTF-8 as Latin ones, as a word of another script or as signs beside one."""
        far = [x for x in text if x not in self.known and not (strict and ord(x) < 0x180)]
        letters = [x for x in text if x.isalpha() and ord(x) >= 0x180] if far else []
        return (text.isprintable() if strict else not far) and (not far or (len(letters) > 1 and len({script(x) for x in letters}) == 1))

    def reads(self, left: str, run: str, right: str) -> float:
        """Log-probability of a run in clean text."""
        return float(self.log_c[_letters(left, run, right)].sum())

    def _unwind(self, window: str, name: str) -> str | None:
        """The run before the chain, if the chain gives it again; of further layers of misread UTF-8 as many come off as read best."""
        left, run, right = _parts(window)
        back = invert(run, name)
        if back is None or back == run or (name != LOWERED and garble(back, name) != run):
            return None
        layers = [back]
        while name.startswith("utf_8"):
            tried = ((w, invert(layers[-1], f"utf_8>{w}")) for w in _UTF8_AS)
            if (deeper := next((x for w, x in tried if x and x not in layers and garble(x, f"utf_8>{w}") == layers[-1]), None)) is None:
                break
            layers.append(deeper)
        likely = [x for x in layers if self.plausible(x, name.startswith("utf_8"))]
        return max(likely, key=lambda x: self.reads(left, x, right)) if likely else back

    def better(self, left: str, run: str, right: str, back: str, name: str, least: float | None = None) -> bool:
        """Whether the restored run holds plausible characters and reads better, by ``least`` nats if that is given."""
        strict = name.startswith("utf_8")
        if not self.plausible(back, strict):
            return False
        gain = self.reads(left, back, right) - self.reads(left, run, right)
        alone = not strict and not left[-1:].isalpha() and not right[:1].isalpha()
        return gain > (least if least is not None else GAIN_UTF8 if strict else GAIN_ALONE if alone else GAIN_OTHER)

    def together(self, runs: list[str], chains: set[str]) -> str:
        """The chain that could have made most of the runs of a text; among equals the one with the highest sum of scores.

        Of chains that give the same text, it is the first in the list of chains.
        """
        runs = list(dict.fromkeys(runs))
        made = {n: [self.unwind(w, n) for w in runs] for n in chains}
        best = max(sorted(chains), key=lambda n: (sum(x is not None for x in made[n]), sum(self.scores(w)[self.names.index(n)] for w, x in zip(runs, made[n]) if x is not None)))
        return next(n for n in self.names[1:] if n == best or all(self.unwind(w, n) == x for w, x in zip(runs, made[best])))

    def _by_chain(self, window: str, name: str) -> str | None:
        """The run restored by the chain of its text, which needs no margin."""
        left, run, right = _parts(window)
        back = self.unwind(window, name)
        return back if back is not None and self.better(left, run, right, back, name, 0.0) else None


def _parts(window: str) -> tuple[str, str, str]:
    left, _, rest = window.partition("\x02")
    run, _, right = rest.rpartition("\x03")
    return left, run, right


def add_features(row: np.ndarray, of: list[str], n: np.ndarray) -> None:
    """Add the features (:func:`_features`) of many windows to a row of counts, each ``n`` times."""
    coded = [w.encode("utf_8", "surrogatepass") for w in of]
    b = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
    at = np.repeat(np.arange(len(of)), [len(x) for x in coded])
    inner = (b != 2) & (b != 3)
    for x, i, apart, plus in ((b, at, 1, 0), (b[inner], at[inner], 2, 70_001), (b[inner], at[inner], 3, 140_009)):
        same = i[:-apart] == i[apart:]
        h = (x[:-apart] * 257 + x[apart:] + plus)[same] * 2654435761 % (1 << 32) >> 16
        row += np.bincount(h, weights=n[i[:-apart][same]], minlength=BUCKETS)


def count_classes(tally: np.ndarray, clean: list[tuple[str, int]]) -> None:
    """Add the byte bigrams of clean windows to the counts of each class: as they are for no damage, garbled by each chain for the others."""
    of: list[list[str]] = [[] for _ in NAMES]
    times: list[list[int]] = [[] for _ in NAMES]
    for w, n in clean:
        left, run, right = _parts(w)
        for c, name in enumerate(NAMES):
            bad = garble(run, name) if c else run
            if bad is not None and (not c or bad != run):
                g = f"{left}\x02{bad}\x03{right}"
                of[c].append(g.lower() if name == LOWERED else g)
                times[c].append(n)
    for c in range(len(NAMES)):
        if of[c]:
            add_features(tally[c], of[c], np.array(times[c], dtype=np.float64))


def count_letters(chars: np.ndarray, clean: list[tuple[str, int]]) -> None:
    """Add the character bigrams of clean windows to their counts."""
    for w, n in clean:
        np.add.at(chars, _letters(*_parts(w)), n)


def train(counts: Counter[str], seen: Counter[str]) -> Model:
    """Fit on windows with their counts; ``seen`` counts the characters of all clean windows (:func:`_clean`)."""
    tally, chars = np.zeros((len(NAMES), BUCKETS)), np.zeros(BUCKETS)
    clean = [(w, n) for w, n in counts.items() if _clean(w)]
    count_classes(tally, clean)
    count_letters(chars, clean)
    return model_of(tally, chars, frozenset(c for c, n in seen.items() if n >= 2))


def model_of(tally: np.ndarray, chars: np.ndarray, known: frozenset[str]) -> Model:
    """The model of counts of byte bigrams by class, of character bigrams of clean text, and of the characters in use.

    Runs that can strictly be read as UTF-8 taken for a code page do not count as clean. What other
    damage the texts have stays in; it is rare against the same words undamaged, as copies of a text
    do not count.
    """
    count_classes(tally, [(w, 1) for w in other_scripts()])
    total = tally.sum(axis=1, keepdims=True)
    log_p = np.log((tally + 0.02) / (total + 0.02 * BUCKETS))
    log_p[1:][total[1:, 0] == 0] = -1e9
    return Model(log_p, list(NAMES), np.log((chars + 0.1) / (chars.sum() + 0.1 * BUCKETS)), known)


def other_scripts(words: int = 100, seed: int = 7) -> Iterator[str]:
    """Windows of made-up words of scripts that the corpus may not have, so that their bytes are not new to the classifier."""
    rng = np.random.default_rng(seed)
    for first, last in SCRIPTS:
        for _ in range(words):
            yield " \x02" + "".join(map(chr, rng.integers(first, last + 1, rng.integers(2, 9)))) + "\x03 "


def _clean(window: str) -> bool:
    """Whether a run counts as clean at first."""
    return REPLACED not in window and not _decodable(window)


def _decodable(window: str) -> bool:
    """Whether a run can strictly be read as UTF-8 that was taken for a code page, so that it does not count as clean at first."""
    run = _parts(window)[1]
    for codec in _UTF8_AS:
        if (data := encode(run, codec)) is not None and (text := decode(data, "utf_8")) is not None and text != run and all(c.isprintable() and ord(c) < 0x2200 for c in text):
            return not 0x500 <= max(map(ord, text)) < 0x1E00
    return False


def repair(model: Model, text: str | None) -> tuple[int, int, str | None, str | None]:
    """(damaged runs, restored runs, chain, restored text) of one text."""
    if not text or text.isascii():
        return 0, 0, None, text
    first, seen = None, set()
    while text not in seen:  # damage within damage
        seen.add(text)
        runs = [(i, j, w, *model.judge(w)) for i, j, w in windows(text)]
        chains = Counter(c for *_, c, back in runs if back is not None)
        chain = next((c for *_, c, _ in runs if c), None)
        if chains:
            chain = model.together([w for _, _, w, _, back in runs if back is not None], set(chains))
            # the chain of the text takes all runs that it could have made, also those that alone were not plain enough
            runs = [(i, j, w, *((chain, x) if c != "replaced" and (x := model.by_chain(w, chain)) is not None else (c, back))) for i, j, w, c, back in runs]
        out, at = [], 0
        for i, j, _, _, back in runs:
            if back is not None:
                out += [text[at:i], back]
                at = j
        first = first or (sum(c is not None for *_, c, _ in runs), sum(back is not None for *_, back in runs), chain)
        text = "".join([*out, text[at:]])
    return (*first, text)


def fit(df: DataFrame, text_col: str) -> Model:
    """Train on all distinct texts, each counted once however many copies it has.

    Tasks count the bigrams and characters of the distinct windows; what comes to the driver is
    the sum of a class in one row, of the same size for any input, and the characters in use.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"h": frame["h"], "ws": [list(dict.fromkeys(w for _, _, w in windows(t))) for t in frame["t"]]})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, chars, seen = np.zeros((len(NAMES), BUCKETS)), np.zeros(BUCKETS), Counter()
        for frame in frames:
            clean = [(w, n) for w, n in zip(frame["w"], frame["n"]) if _clean(w)]
            count_classes(tally, clean)
            count_letters(chars, clean)
            for w, n in clean:
                for c in set(_parts(w)[1]):
                    seen[c] += n
        for k, row in [*enumerate(tally), (len(NAMES), chars)]:
            b = np.flatnonzero(row)
            yield pd.DataFrame({"k": np.int32(k), "b": b.astype(np.int32), "n": row[b]})
        yield pd.DataFrame({"k": np.int32(-1), "b": np.array([ord(c) for c in seen], dtype=np.int32), "n": np.array(list(seen.values()), dtype=np.float64)})

    def row_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            data = "".join(chr(c) for c in sorted(frame["b"][frame["n"] >= 2])).encode("utf_8", "surrogatepass")
        else:
            data = np.bincount(frame["b"], weights=frame["n"], minlength=BUCKETS).tobytes()
        return pd.DataFrame({"k": [key[0]], "data": [data]})

    texts = df.select(F.col(text_col).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]")).select(F.md5("t").alias("h"), "t")
    each = texts.mapInPandas(split, "h string, ws array<string>").groupBy("h").agg(F.first("ws").alias("ws"))
    rows = each.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # a number of tasks of its own: the table is short, but each of its rows goes through all chains
    rows = rows.repartition(min(COUNT_TASKS, max(2, df.sparkSession.sparkContext.defaultParallelism)), "w")
    sums = rows.mapInPandas(count, "k int, b int, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).groupBy("k").applyInPandas(row_of, "k int, data binary")
    found = {r["k"]: bytes(r["data"]) for r in sums.collect()}
    dense = np.array([np.frombuffer(found[k]) if k in found else np.zeros(BUCKETS) for k in range(len(NAMES) + 1)])
    return model_of(dense[:-1], dense[-1], frozenset(found.get(-1, b"").decode("utf_8", "surrogatepass")))


def find_wrong_encoding(df: DataFrame, id_col: str, text_col: str, model: Model | None = None) -> DataFrame:
    """(id, damaged runs, restored runs, chain, restored text) of every record with damage."""
    model = model or fit(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.log_p.astype(np.float32), model.names, model.log_c, model.known))
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for frame in frames:
            done = [repair(own, t) for t in frame["t"]]
            keep = [i for i, d in enumerate(done) if d[0]]
            if keep:
                yield pd.DataFrame({"id": frame["id"].iloc[keep], "damaged_runs": [done[i][0] for i in keep], "restored_runs": [done[i][1] for i in keep], "chain": [done[i][2] for i in keep], "restored_text": [done[i][3] for i in keep]})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    return rows.mapInPandas(run, f"id {kind}, damaged_runs int, restored_runs int, chain string, restored_text string").withColumnRenamed("id", id_col)
