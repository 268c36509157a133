"""Mapping freely typed values to the entries of a reference list.

The reference entries and their aliases form a trie that is searched with a Levenshtein
automaton (bit-parallel, with transpositions as one edit). Alias paths are all names of an
entry, names with a place before or after them, cut-off ends marked with a full stop, and
what a :class:`Spelling` adds: letters that are exchanged, and words before and after a name.
All entries within a distance are found; the nearest one counts. The distance depends on the
length: on that of the name or on that of the typed value, whichever allows less. Where
nothing is found, one edit is taken back before the search, for two letters that were exchanged
with another lost between them, and for letters that sound alike after an edit.

Letters are compared without case; Latin ones also without accents. Letters and digits of
any script count, everything else is left out.

Defined results: null and empty values, and values without letters or digits, denote
nothing. A value as near to two different entries denotes neither (``entry`` is null;
``entries`` has all that were found). Every distinct value is searched once. Entries without
a name are never found; an empty reference list finds nothing. A list longer than
``PIECE_ENTRIES`` is searched piece by piece.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import stage

#: Entries of the reference list that a worker holds at once.
PIECE_ENTRIES = 50_000
# Latin letters that Unicode does not take apart.
PLAIN_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th", "ħ": "h", "ŧ": "t", "ß": "ss"})
_CUT = re.compile(r"(?<=\w\w)\.+(?=\s|,|$)")


@dataclass(frozen=True)
class Spelling:
    """What may differ between typed values and names beside typing errors; nothing, unless said.

    ``before``, ``after``: words written before or after a name; ``digits``: digits typed for
    letters; ``sounds``: (letters in the name, letters as typed); ``ands``: words for an ampersand.
    """

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    digits: dict[str, str] = field(default_factory=dict)
    sounds: tuple[tuple[str, str], ...] = ()
    ands: tuple[str, ...] = ()

    def undecorated(self, text: str) -> str:
        """The text without words before a name that end in a point or colon and words after it; short ones only after a point."""
        of = lambda words: "|".join(map(re.escape, words))
        parts = []
        if self.before:
            parts.append(rf"\b(?:{of(self.before)})[.:]")
        if self.after:
            parts.append(rf"\.(?:{of(self.after)})\b")
        if long := [w for w in self.after if len(w) > 4]:
            parts.append(rf"[\s–-]*\(?\b(?:{of(long)})\b\)?")
        return re.sub("(?i)" + "|".join(parts), "", text) if parts else text


def fold(text: str, digits: dict[str, str] | None = None) -> str:
    """Lower case, Latin letters without accents, without blanks and punctuation; a full stop that cuts a word off becomes \\x01."""
    out: list[str] = []
    for c in unicodedata.normalize("NFKD", _CUT.sub("\x01", text.casefold())):
        mark = unicodedata.category(c)[0] == "M"
        if c == "\x01" or c.isalnum() or (mark and out and out[-1] > "\u024f"):
            out.append(c)
    text = unicodedata.normalize("NFC", "".join(out)).translate(PLAIN_LETTERS)
    return text.translate(str.maketrans(digits)) if digits and any(c.isalpha() for c in text) else text


def allowed(length: int) -> int:
    """The distance allowed to so many letters."""
    return 0 if length < 5 else 1 if length < 7 else 2 if length < 16 else 3


def readings(value: str, spelling: Spelling) -> list[str]:
    """The value folded as it stands, with what precedes a comma put after it, and with its first word put last."""
    forms, spaced = [value], value.replace("_", " ")
    for text in dict.fromkeys((spaced, spelling.undecorated(spaced))):
        parts = text.split(",")
        if len(parts) > 1:
            forms.append(" ".join([*parts[1:], parts[0]]))
            if len(parts) > 2:
                forms.append(" ".join([*parts[1:-1], parts[0], parts[-1]]))
                forms.append(" ".join([parts[-1], parts[0], *parts[1:-1]]))
        elif len(words := text.split()) > 1:
            forms.append(" ".join([*words[1:], words[0]]))
    return list(dict.fromkeys(f for x in forms if (f := fold(x, spelling.digits))))


class Trie:
    """Names of entries; beside them, one trie of all places and one of the words after a name, which every name shares."""

    def __init__(self, entries: Iterable[tuple[int, str, str]], spelling: Spelling = Spelling()):
        """``entries``: (entry number, name, place or an empty string) - a number may come with several names."""
        self.spelling = spelling
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int, int]]] = [[]]  # ("name", entry, letters), ("place", number, 0) or ("word", 0, 0)
        self.after, self.places = self._new(), self._new()
        self.place_of: dict[int, set[int]] = {}
        numbers: dict[str, int] = {}
        for word in spelling.after:
            self._path(self.after, word, ("word", 0, 0), cut=4)
        for entry, name, place in entries:
            plain = fold(name)
            if not plain:
                continue
            forms = {plain}
            if len(plain) > 4:
                for typed in spelling.sounds:
                    forms |= {f.replace(*typed) for f in forms}
                if "&" in name:
                    forms |= {fold(name.replace("&", f" {w} ")) for w in spelling.ands}
                if where := fold(place or ""):
                    if where not in numbers:
                        numbers[where] = len(numbers)
                        self._path(self.places, where, ("place", numbers[where], 0), cut=max(1, len(where) - 4))
                    self.place_of.setdefault(entry, set()).add(numbers[where])
            for form in forms:
                self._path(0, form, ("name", entry, len(plain)), cut=max(5, len(form) - 4) if len(form) > 6 else len(form))

    def _new(self) -> int:
        self.next.append({})
        self.ends.append([])
        return len(self.next) - 1

    def _step(self, node: int, char: str) -> int:
        if (to := self.next[node].get(char)) is None:
            to = self.next[node][char] = self._new()
        return to

    def _path(self, node: int, word: str, end: tuple[str, int, int], cut: int) -> None:
        """A word that may be cut off after ``cut`` letters or more."""
        for i, char in enumerate(word, 1):
            node = self._step(node, char)
            if cut <= i < len(word):
                self._mark(self._step(node, "\x01"), end)
        self._mark(node, end)

    def _mark(self, node: int, end: tuple[str, int, int]) -> None:
        if end not in self.ends[node]:
            self.ends[node].append(end)

    def twice_edited(self, typed: str) -> dict[int, int]:
        """What a search finds after one edit is taken back that it cannot combine with others at the same place.

        Two letters that were exchanged, with a letter lost between them, and letters that sound
        alike, of which one came to stand beside the other by an edit.
        """
        back = {typed[:i] + typed[i + 1] + typed[i] + typed[i + 2 :] for i in range(len(typed) - 1) if typed[i] != typed[i + 1]}
        for name, heard in self.spelling.sounds:
            at = typed.find(heard)
            while at >= 0:
                back.add(typed[:at] + name + typed[at + len(heard) :])
                at = typed.find(heard, at + 1)
        near: dict[int, int] = {}
        self._search(typed, near, -1)  # within one edit more than allowed, else it cannot be
        best: dict[int, int] = {}
        for text in back if near else ():
            self._search(text, best, 1)
        return best

    def search(self, typed: str) -> dict[int, int]:
        """Entry to distance, for all entries within the distance allowed to them."""
        best: dict[int, int] = {}
        heads = self.spelling.before
        for text in [typed] + [typed[len(w) :] for w in heads if typed.startswith(w) and len(typed) > len(w) + 2]:
            self._search(text, best)
        if not best or min(best.values()) > 1:  # a word before the name with an edit in it
            for w in heads:
                for n in (len(w) - 1, len(w), len(w) + 1):
                    if typed[:n] != w and len(typed) > n + 4 and _close(typed[:n], w):
                        self._search(typed[n:], best, 1)
        return best

    def _search(self, typed: str, best: dict[int, int], spent: int = 0) -> None:
        most = allowed(len(typed)) - spent
        if most < 0:
            return
        masks: dict[str, int] = {}
        for i, char in enumerate(typed):
            masks[char] = masks.get(char, 0) | (2 << i)
        full = 1 << len(typed)
        limit = (full << 1) - 1
        zero = [0] * (most + 1)

        def found(entry: int, letters: int, states: list[int]) -> None:
            for d in range(min(most, allowed(letters) - spent) + 1):
                if states[d] & full:
                    best[entry] = min(best.get(entry, 99), d + spent)
                    return

        # states[d]: bit i is set if i letters typed match the path with d edits
        start = [(2 << d) - 1 for d in range(most + 1)]
        # (node, states, states and mask of the letter before, (entry, letters) behind, place in front)
        stack = [(0, start, zero, 0, None, None), (self.places, start, zero, 0, None, None)]
        while stack:
            node, states, before, last, name, place = stack.pop()
            for char, to in self.next[node].items():
                m = masks.get(char, 0)
                new = [(states[0] << 1) & m]
                for d in range(1, most + 1):
                    if char == "\x01":  # a word is cut off only where the stop was typed
                        new.append((states[d] << 1) & m)
                        continue
                    turned = (((before[d - 1] << 1) & m) << 1) & last
                    new.append((((states[d] << 1) & m) | states[d - 1] | (states[d - 1] << 1) | (new[d - 1] << 1) | turned) & limit)
                if not new[most]:
                    continue
                stack.append((to, new, states, m, name, place))
                for kind, number, letters in self.ends[to]:
                    if kind == "name":
                        where = self.place_of.get(number, ()) if letters > 4 else ()
                        if place is not None and place not in where:
                            continue
                        found(number, letters, new)
                        stack.append((self.after, new, zero, 0, (number, letters), place))
                        if place is None and where:
                            stack.append((self.places, new, zero, 0, (number, letters), None))
                    elif kind == "word":
                        found(*name, new)
                    elif name is None:
                        stack.append((0, new, zero, 0, None, number))
                    elif number in self.place_of[name[0]]:
                        found(*name, new)
                        stack.append((self.after, new, zero, 0, name, number))


def _close(a: str, b: str) -> bool:
    """Whether one edit or none leads from a to b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def resolve(trie: Trie, value: str | None) -> list[tuple[int, int]]:
    """(distance, entry) of all entries that a typed value may denote, the nearest first."""
    found: dict[int, int] = {}
    forms = readings(value or "", trie.spelling)
    for find in (trie.search, trie.twice_edited):
        for form in forms:
            for entry, d in find(form).items():
                found[entry] = min(d, found.get(entry, 99))
        if found:
            break
    return sorted((d, e) for e, d in found.items())


_built: dict[str, Trie] = {}  # the trie that this worker built last


def map_values(df: DataFrame, value_col: str, reference: DataFrame, entry_col: str, name_cols: list[str], place_col: str | None = None, spelling: Spelling = Spelling()) -> DataFrame:
    """(typed value, ``entry``, ``distance``, ``n_entries``, ``entries``) of every distinct value that is not null.

    The trie is built from the reference list, which goes to the workers in pieces of
    bounded length; the values stay distributed.
    """
    spark = df.sparkSession
    kind = dict(reference.dtypes)[entry_col]
    cols = [F.col(entry_col).alias("entry"), *[F.col(c).alias(f"n{i}") for i, c in enumerate(name_cols)], (F.col(place_col) if place_col else F.lit("")).alias("place")]
    listed = reference.select(*cols).where("entry is not null")
    pieces = max(1, -(-listed.count() // PIECE_ENTRIES))
    values = df.select(F.col(value_col).alias("v")).where("v is not null").distinct()
    # by size alone, all values would meet in one task; the search costs time, not room
    values = values.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64("v"))
    if pieces > 1:
        values = stage(values, "typed-values")
    schema = f"v string, entries array<struct<distance: int, entry: {kind}>>"

    def one(piece: int) -> DataFrame:
        rows = listed.where(F.pmod(F.xxhash64("entry"), F.lit(pieces)) == piece).orderBy("entry").collect()  # about PIECE_ENTRIES rows
        entries = list(dict.fromkeys(r["entry"] for r in rows))
        number = {e: i for i, e in enumerate(entries)}
        names = [(number[r["entry"]], name, r["place"] or "") for r in rows for name in r[1:-1] if name]
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, entries, names))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mark, entries, names = shared.value
            if mark not in _built:
                _built.clear()
                _built[mark] = Trie(names, spelling)
            for frame in frames:
                yield pd.DataFrame({"v": frame["v"], "entries": [[{"distance": d, "entry": entries[e]} for d, e in resolve(_built[mark], v)] for v in frame["v"]]})

        return values.mapInPandas(search, schema)

    found = one(0)
    if pieces > 1:
        for piece in range(1, pieces):
            found = found.unionByName(one(piece))
        found = found.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))
    first, second = F.get("entries", F.lit(0)), F.get("entries", F.lit(1))
    alone = F.coalesce(second["distance"] > first["distance"], F.lit(True))
    return found.select(F.col("v").alias(value_col), F.when(alone, first["entry"]).alias("entry"), first["distance"].alias("distance"), F.size("entries").alias("n_entries"), "entries")
