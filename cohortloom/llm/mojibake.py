"""Garbled text from wrong character encoding: clean near-twins, learned transformations, restoration.

1. Units. A text's non-ASCII characters are looked at in units: the word around them, or, for lone
   symbols, the symbols with the words beside them (digits made 0). Distinct units are counted by
   documents over the whole corpus.
2. Twins. Units are joined with their clean near-twin, the most frequent unit with the same text
   once non-ASCII characters are stripped. Each skeleton has one such twin, so no pairs multiply.
3. Learning by alignment. The runs of non-ASCII characters of a unit and its twin are aligned between
   their ASCII characters and cut into characters; a mapping from a garbled sequence to a character is
   learned if several units show it and the sequence is not at home in clean twins. Nothing but the
   corpus goes into these mappings.
4. Fallback by catalogue. What no mapping covers is tried with pairs of known encodings (written in S,
   decoded as D), but only those that explain aligned runs, or, where the stripped text is empty
   (other scripts), whose result is itself a frequent unit of the corpus.
5. Application. Mappings and pairs are applied to all units. A restored form counts if it is much more
   frequent in the corpus than the garbled one, or if its characters follow each other in a much more
   usual way (counts of character pairs over the whole corpus; a unit is no evidence for itself).
   One symbol for another is weak evidence, as most symbols are some other's image: it counts only
   if the same words stand beside the restored one. U+FFFD and control characters that no text has
   mark what cannot be had back. `decoded` tells the branch: aligned, an encoding, or '' for marks.

Defined cases. Null, empty and pure ASCII texts are not affected. Of repeated rows (same doc_id)
each distinct text is looked at, and the doc_id is listed once. Ties go to the mapping learned by
alignment, then to the more usual result, then to the first in alphabetical order. Texts and units
are looked at whole, however long.
"""

from __future__ import annotations

import codecs
import importlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, durable, parallelism

#: Names of encodings in which text may have been written, and as which it may have been decoded.
WRITTEN = ["utf_8", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp932", "euc_jp", "gb18030", "big5", "cp949"]
DECODED = ["cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866", "koi8_r"]
MULTI = ["cp932", "euc_jp", "gb18030", "big5", "cp949"]
WIDE = ["gbk", "cp932", "big5", "cp949", "euc_jp"]

#: A unit with the ASCII words beside it, and its core. It starts where a word does, so each word is scanned once.
UNIT = r"(?<![0-9A-Za-z])[0-9A-Za-z]*+ ?+[^\x00-\x7F][0-9A-Za-z[^\x00-\x7F]]*+(?: [0-9A-Za-z]++(?![^\x00-\x7F]))?+"
CORE = r"[0-9A-Za-z]*+[^\x00-\x7F][0-9A-Za-z[^\x00-\x7F]]*+"
#: ASCII characters that no unit holds: all but letters, digits and the blank.
BREAKS = r"[\x00-\x1F!-/:-@\[-`{-\x7F]"
#: A core that says enough without the words beside it.
STRONG = r"[A-Za-z].*[A-Za-z]|[^\x00-\x7F]{3}"
#: The sign for what could not be decoded.
LOST_SIGN = r"\x{FFFD}"
#: Characters that only a wrong decoder leaves: U+FFFD and C1 controls (but for U+0085, a line end).
LOST = r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]"
#: A twin or restored form must be in so many times the documents of the garbled one.
MUCH = 4
#: The same for a lone symbol without words on both sides.
MUCH_ALONE = 50
#: Least gain of the mean log count of character pairs.
GAIN = 2.0
#: Distinct aligned pairs (or restored units with a twin) from which a transformation counts as learned.
SUPPORT = 2
#: Characters whose pairs are counted: alphabets below U+0530, and punctuation, symbols and box drawing. Of other
#: scripts single characters are, so counts have at most 4400^2 + 0x110000 keys however large the corpus is.
LOW, SYMBOLS = 0x530, (0x2000, 0x2C00)
WIDTH = LOW + SYMBOLS[1] - SYMBOLS[0]
SINGLE = WIDTH * WIDTH
#: Counts are held in blocks of so many keys; blocks without a count are left out.
BLOCK = 512
#: Share of the evidence on a garbled sequence that its mapping must have.
PURITY = 0.5
#: Longest sequence that is looked for in clean twins; a longer one is garbled beyond doubt.
GRAM = 6
#: Most mappings that the driver takes; more raise an error.
MAX_MAPS = 200_000


@lru_cache(maxsize=None)
def _narrow(codec: str) -> tuple:
    """Encoding map of a one-byte encoding, in which bytes without a character stand for themselves, as decoders leave them; and its non-ASCII characters."""
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(codec) if b > 127 else chr(b))
        except UnicodeDecodeError:
            table.append(chr(b))
    own = set(table[128:])
    # a byte that stands for itself gives way to the character that has its number elsewhere
    return codecs.charmap_build("".join(table)), frozenset(own)


def raw_bytes(text: str, decoded: str) -> list[bytes | str]:
    """The bytes that were decoded; parts that cannot come from `decoded` stay text."""
    if decoded in WIDE:
        try:
            return [text.encode(decoded)]
        except UnicodeEncodeError:
            return [text]
    table, out = _narrow(decoded)[0], []
    while text:
        try:
            out.append(codecs.charmap_encode(text, "strict", table)[0])
            break
        except UnicodeEncodeError as e:
            if e.start:
                out.append(codecs.charmap_encode(text[: e.start], "strict", table)[0])
            out.append(text[e.start : e.end])
            text = text[e.end :]
    return out


@lru_cache(maxsize=None)
def _decoder(codec: str) -> tuple:
    """What decodes bytes, and the table of a one-byte encoding, so that the call goes straight to it."""
    table = getattr(importlib.import_module(f"encodings.{codec}"), "decoding_table", None)
    return (codecs.getdecoder(codec), None) if table is None else (codecs.charmap_decode, table)


def undo(parts: list[bytes | str], written: str, lossy: bool = False) -> str | None:
    """Text whose bytes are decoded as they were written; None if nothing can be.

    A character cut off at the end of a part is left out. Lossy: bytes were dropped on the way; what
    is left of UTF-8 is decoded, with U+FFFD for the rest, if it is at least a seventh.
    """
    if not lossy and written not in MULTI:
        # one part that does not decode rules the whole out, as below, but without building it up
        try:
            decode, table = _decoder(written)
            if table is None:
                return "".join([p if isinstance(p, str) else decode(p, "strict")[0] for p in parts])
            return "".join([p if isinstance(p, str) else decode(p, "strict", table)[0] for p in parts])
        except UnicodeDecodeError:
            return None
    out, changed = [], False
    for p in parts:
        if isinstance(p, bytes) and not p.isascii():
            try:
                p = p.decode(written)
                changed = True
            except UnicodeDecodeError as e:
                if lossy and written == "utf_8":
                    p = p.decode("utf_8", "replace")
                    good = sum(c > "\x7f" and c != "\ufffd" for c in p)
                    changed = good >= 2 and 6 * good >= p.count("\ufffd")
                    if not changed:
                        return None
                elif written in MULTI and e.start >= max(len(p) - 2, 1):
                    p = p[: e.start].decode(written)
                    changed = True
                else:
                    return None
        out.append(p if isinstance(p, str) else p.decode("ascii"))
    return "".join(out) if changed else None


def transformations() -> list[tuple[str, str]]:
    """All (decoded, written) that may be learned."""
    return [(d, w) for d in [*DECODED, *WIDE] for w in WRITTEN if d != w]


def runs(text: str) -> tuple[str, dict[int, str]]:
    """ASCII characters of a text, and its non-ASCII runs by the number of ASCII characters before them."""
    ascii_, found = [], {}
    for c in text:
        if ord(c) < 128:
            ascii_.append(c)
        else:
            found[len(ascii_)] = found.get(len(ascii_), "") + c
    return "".join(ascii_), found


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Runs that stand at the same places between the same ASCII characters and differ."""
    a, x = runs(garbled)
    b, y = runs(clean)
    return [(x[i], y[i]) for i in x if x[i] != y[i]] if a == b and x.keys() == y.keys() else []


class Places(dict):
    """Number of each paired character; for others, their code point made negative."""

    def __missing__(self, c: str) -> int:
        n = ord(c)
        at = self[c] = n if n < LOW else n - SYMBOLS[0] + LOW if SYMBOLS[0] <= n < SYMBOLS[1] else -n
        return at


PLACES = Places()


def features(text: str) -> list[int]:
    """Keys of the pairs with a non-ASCII character, and of single characters of the scripts that are not paired."""
    out, a = [], 32
    for b in map(PLACES.__getitem__, text + " "):
        if b < 0:
            out.append(SINGLE - b)
        elif a >= 0 and (a > 127 or b > 127):
            out.append(a * WIDTH + b)
        a = b
    return out


class Usage:
    """Documents by feature: at most 4400^2 + 0x110000 counts, in blocks."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.blocks: dict[int, np.ndarray] = {}
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        blocks, first = np.unique(keys // BLOCK, return_index=True)
        for b, i, j in zip(blocks.tolist(), first, np.r_[first[1:], len(keys)]):
            block = self.blocks[b] = np.zeros(BLOCK, dtype=np.float32)
            block[keys[i:j] % BLOCK] = counts[i:j]
        single = keys >= SINGLE
        paired = keys[~single]
        places = np.unique(np.r_[paired // WIDTH, paired % WIDTH]).tolist()
        self.known = {chr(p if p < LOW else p - LOW + SYMBOLS[0]) for p in places} | {chr(c) for c in (keys[single] - SINGLE).tolist()}
        self.start()

    def start(self) -> None:
        self.all, self.others = Logs(self.blocks, 0), Logs(self.blocks, 1)
        self.top = max((math.log(float(b.max()) + 0.5) for b in self.blocks.values()), default=0.0)

    def usual(self, text: str, own: bool = False, least: float | None = None) -> float | None:
        """Mean log count of the features; own: of a unit of the corpus, without the document that it is from.

        With `least`, None as soon as the rest of the text cannot bring the mean above it, however usual.
        """
        logs, total, k, a = self.others if own else self.all, 0.0, 0, 32
        places = [*map(PLACES.__getitem__, text), 32]
        for i in range(0, len(places), 16):
            # the features, one by one
            for b in places[i : i + 16]:
                if b < 0:
                    total += logs[SINGLE - b]
                    k += 1
                elif a >= 0 and (a > 127 or b > 127):
                    total += logs[a * WIDTH + b]
                    k += 1
                a = b
            if least is not None and (left := len(places) - i - 16) > 0 and total + left * self.top <= least * (k + left):
                return None
        return total / k if k else 0.0

    def __getstate__(self) -> tuple:
        return self.blocks, self.known

    def __setstate__(self, state: tuple) -> None:
        self.blocks, self.known = state
        self.start()


class Logs(dict):
    """Log counts by feature, less some documents; an unseen feature counts as half a document."""

    def __init__(self, blocks: dict[int, np.ndarray], less: int):
        super().__init__()
        self.blocks, self.less = blocks, less

    def __missing__(self, key: int) -> float:
        block = self.blocks.get(key // BLOCK)
        n = 0.0 if block is None else float(block[key % BLOCK])
        got = self[key] = math.log(max(n - self.less, 0.0) + 0.5)
        return got


def doc_units(documents: DataFrame) -> DataFrame:
    """doc_id and the distinct units of its text. Written once, as texts are read once; several stages use it."""
    df = documents.select("doc_id", "text").filter(F.octet_length("text") != F.length("text"))
    # no unit holds a character of BREAKS: the pattern is run on the pieces between them that hold non-ASCII characters
    pieces = F.filter(F.split("text", BREAKS), lambda x: F.octet_length(x) != F.length(x))
    text = F.regexp_replace(F.array_join(pieces, "\n"), "[0-9]++", "0")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(UNIT), 0))
    return durable(df.select("doc_id", F.array_distinct(F.transform(found, normal)).alias("units")))


def normal(found: Column) -> Column:
    """The unit: its core without digits at its ends if that has letters enough, else the core with the words beside it; digits are 0 by now."""
    core = F.regexp_extract(found, CORE, 0)
    return F.when(core.rlike(STRONG), F.btrim(core, F.lit("0"))).otherwise(found)


def corpus_units(by_doc: DataFrame) -> DataFrame:
    """unit and n, the number of documents that hold it; written once."""
    df = by_doc.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    # few bytes but much work each: partitions of a set number, so that they aren't coalesced into a few tasks
    return durable(df.repartition(2 * parallelism(df.sparkSession), "unit"))


def pair_counts(units: DataFrame) -> Usage:
    """Documents by feature, over all units; the driver takes at most 20.5 million counts of 12 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out: dict[int, int] = {}
            for u, n in zip(df["unit"], df["n"]):
                for f in set(features(u)):
                    out[f] = out.get(f, 0) + n
            yield pd.DataFrame({"f": list(out.keys()), "n": list(out.values())})

    got = units.mapInPandas(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    return Usage(got["f"].to_numpy(), got["n"].to_numpy())


def twins(units: DataFrame) -> DataFrame:
    """unit, n, twin: each unit with the most frequent one of the same stripped text, if that is much more frequent."""
    skeleton = F.regexp_replace("unit", r"[^\x00-\x7F]++", "")
    df = units.withColumn("skeleton", skeleton).filter(F.length(F.regexp_replace("skeleton", "[^A-Za-z]", "")) >= 2)
    best = df.groupBy("skeleton").agg(F.max(F.struct("n", "unit")).alias("t"))
    df = df.join(best, "skeleton").filter((F.col("t.unit") != F.col("unit")) & (F.col("t.n") >= MUCH * F.col("n")))
    return df.select("unit", "n", F.col("t.unit").alias("twin"))


def cut(garbled: str, clean: str) -> list[tuple[str, str]]:
    """An aligned run as mappings to single characters, where its length allows; else as one mapping."""
    k, rest = divmod(len(garbled), len(clean))
    if rest or not k:
        return [(garbled, clean)]
    return [(g, c) for i, c in enumerate(clean) if (g := garbled[i * k : (i + 1) * k]) != c]


def _mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mappings that the alignment of each unit with its twin shows, with the number of such units."""
    for df in batches:
        out: dict[tuple[str, str], int] = {}
        for u, t in zip(df["unit"], df["twin"]):
            for pair in {p for g, c in aligned(u, t) for p in cut(g, c)}:
                out[pair] = out.get(pair, 0) + 1
        yield pd.DataFrame([(g, c, n) for (g, c), n in out.items()], columns=["garbled", "clean", "n"])


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequences within the non-ASCII runs of clean twins, with the number of twins that hold them."""
    for df in batches:
        out: dict[str, int] = {}
        for t in df["twin"]:
            for g in {r[i:j] for r in runs(t)[1].values() for i in range(len(r)) for j in range(i + 1, min(len(r), i + GRAM) + 1)}:
                out[g] = out.get(g, 0) + 1
        yield pd.DataFrame({"garbled": list(out.keys()), "at_home": list(out.values())})


def learn_maps(pairs: DataFrame) -> dict[str, str]:
    """Clean text by garbled sequence, from units and their twins.

    A mapping needs SUPPORT units and PURITY of all evidence on its sequence, to which the clean twins
    that hold the sequence count. Mappings are few, as sequences are those of characters.
    """
    shown = pairs.mapInPandas(_mapped, "garbled string, clean string, n bigint").groupBy("garbled", "clean").agg(F.sum("n").alias("n"))
    shown = durable(shown.filter(~F.col("garbled").rlike(LOST_SIGN)))
    home = pairs.select("twin").distinct().mapInPandas(_grams, "garbled string, at_home bigint").groupBy("garbled").agg(F.sum("at_home").alias("at_home"))
    best = shown.groupBy("garbled").agg(F.max_by("clean", F.struct("n", "clean")).alias("clean"), F.max("n").alias("n"), F.sum("n").alias("all"))
    best = best.filter(F.col("n") >= SUPPORT).join(home, "garbled", "left")
    rows = best.filter(F.col("n") >= PURITY * (F.col("all") + F.coalesce("at_home", F.lit(0)))).select("garbled", "clean").limit(MAX_MAPS + 1).collect()
    if len(rows) > MAX_MAPS:
        raise ValueError(f"more than {MAX_MAPS} mappings")
    return {r["garbled"]: r["clean"] for r in rows}


def mapped_form(unit: str, maps: dict[str, str], longest: int) -> str:
    """The unit with its garbled sequences replaced, longest first from the left."""
    out, i = [], 0
    while i < len(unit):
        if unit[i] >= "\x80":
            for j in range(min(len(unit), i + longest), i, -1):
                if (c := maps.get(unit[i:j])) is not None:
                    out.append(c)
                    i = j
                    break
            else:
                out.append(unit[i])
                i += 1
        else:
            out.append(unit[i])
            i += 1
    return "".join(out)


def _explains(garbled: str, clean: str) -> list[tuple[str, str]]:
    return [(d, w) for d in [*DECODED, *WIDE] for parts in [raw_bytes(garbled, d)] for w in WRITTEN if d != w and undo(parts, w) == clean]


def _aligned_support(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    explains = lru_cache(maxsize=100_000)(_explains)
    for df in batches:
        out = {(d, w, f"{g}\t{c}") for u, t in zip(df["unit"], df["twin"]) for g, c in aligned(u, t) for d, w in explains(g, c)}
        yield pd.DataFrame(sorted(out), columns=["decoded", "written", "case"])


#: Characters that a restored text may hold without their being in the corpus.
ALWAYS = frozenset(map(chr, range(128))) | {"\ufffd"}


def restored_forms(unit: str, by_decoded: dict[str, list[str]], known: set[str], again: bool, seen: set[str] | None = None) -> list[tuple[str, str, str]]:
    """(restored, decoded, written) of a unit; forms that were seen before are left out, and what is tried is added to them.

    Again: what was UTF-8 may have been garbled before; each such round makes the text shorter, so
    they end by themselves. Other encodings are tried in the first round only.
    """
    if not known >= ALWAYS:
        known = known | ALWAYS
    seen = set() if seen is None else seen
    seen.add(unit)
    out, front, first = [], [unit], True
    while front:
        new = []
        for text in front:
            marks, tried = {c for c in text if c >= "\x80"}, set()
            for d, written in by_decoded.items():
                if marks.isdisjoint(_narrow(d)[1]) if d not in WIDE else len(marks) > 1 and not any("\u2e80" <= c for c in marks):
                    continue
                parts = raw_bytes(text, d)
                key = tuple(parts)
                if all(isinstance(p, str) or p.isascii() for p in parts):
                    continue
                for w in written:
                    if not first and w != "utf_8" or (key, w) in tried:
                        continue
                    tried.add((key, w))
                    v = undo(parts, w)
                    if v is None and w == "utf_8" and d in ("latin_1", "cp1252"):
                        v = undo(parts, w, lossy=True)
                    if v is None or v in seen:
                        continue
                    seen.add(v)
                    if again and w == "utf_8" and not v.isascii():
                        new.append(v)
                    if known.issuperset(v):
                        out.append((v, d, w))
        front, first = new, False
    return out


def candidates(units: DataFrame, counts: Usage | Broadcast, allowed: list[tuple[str, str]], maps: dict[str, str], again: bool, explained: set[tuple[str, str]] = frozenset(), least: float = 0.0) -> DataFrame:
    """unit, n, decoded, written, restored, gain: what mappings and transformations make of each unit, where it gains more than `least`.

    What the transformations in `explained` make of it is left out.
    """
    shared = counts if isinstance(counts, Broadcast) else units.sparkSession.sparkContext.broadcast(counts)
    by, other = {}, {}
    for d, w in allowed:
        (other if (d, w) in explained else by).setdefault(d, []).append(w)
    longest, heads = max(map(len, maps), default=0), {g[0] for g in maps}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = shared.value
        known = {c for c in use.known if c >= "\xa0"} | ALWAYS
        for df in batches:
            out = []
            for u, n in zip(df["unit"], df["n"]):
                base = None
                if not heads.isdisjoint(u):
                    v = mapped_form(u, maps, longest)
                    if v != u:
                        base = use.usual(u, True)
                        if (g := use.usual(v) - base) > 0:
                            out.append((u, n, "aligned", "", v, g))
                seen: set[str] = set()
                if other:
                    restored_forms(u, other, known, again, seen)
                if forms := restored_forms(u, by, known, again, seen):
                    base = use.usual(u, True) if base is None else base
                    scored = ((v, d, w, use.usual(v.replace("\ufffd", ""), least=base + least)) for v, d, w in forms)
                    out += [(u, n, d, w, v, g - base) for v, d, w, g in scored if g is not None and g - base > least]
            yield pd.DataFrame(out, columns=["unit", "n", "decoded", "written", "restored", "gain"])

    # few bytes but much work each: partitions of a set number
    spread = units.select("unit", "n").repartition(2 * parallelism(units.sparkSession), "unit")
    return spread.mapInPandas(run, "unit string, n bigint, decoded string, written string, restored string, gain double")


def learn(units: DataFrame, counts: Usage | Broadcast, pairs: DataFrame | None = None) -> list[tuple[str, str]]:
    """Transformations with SUPPORT, by aligned twins or, for units without ASCII letters, by restored twins; at most 368."""
    pairs = twins(units).select("unit", "twin") if pairs is None else pairs
    by_twin = pairs.mapInPandas(_aligned_support, "decoded string, written string, case string").groupBy("decoded", "written").agg(F.countDistinct("case").alias("n"))
    shown = {(r["decoded"], r["written"]): r["n"] for r in by_twin.collect()}
    sure = {t for t, n in shown.items() if n >= SUPPORT}
    other = units.filter(~F.col("unit").rlike("[A-Za-z].*[A-Za-z]"))
    tried = candidates(other, counts, transformations(), {}, False, sure, GAIN / 2 - 1e-9).filter(F.col("gain") >= GAIN / 2)
    known = units.select(F.col("unit").alias("restored"), F.col("n").alias("n_restored"))
    by_form = tried.join(known, "restored").filter(F.col("n_restored") > F.col("n")).select("decoded", "written", F.col("unit").alias("case"))
    for r in by_form.groupBy("decoded", "written").agg(F.countDistinct("case").alias("n")).collect():
        t = r["decoded"], r["written"]
        shown[t] = shown.get(t, 0) + r["n"]
    return sorted(t for t, n in shown.items() if n >= SUPPORT)


def _dropped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units that their twin explains if the control characters among the wrongly decoded ones were dropped."""
    left = lambda c: "".join(x for x in c.encode("utf_8").decode("latin_1") if x >= "\xa0")
    for df in batches:
        out = [(u, t, "latin_1", "utf_8", True) for u, t in zip(df["unit"], df["twin"]) if (pairs := aligned(u, t)) and all(left(c) == g for g, c in pairs)]
        yield pd.DataFrame(out, columns=["unit", "restored", "decoded", "written", "sure"])


def garbled_units(by_doc: DataFrame) -> DataFrame:
    """unit, n, restored (null if it cannot be had back), decoded, written and sure of each garbled unit; written once."""
    units = corpus_units(by_doc)
    pairs = durable(twins(units).select("unit", "twin").repartition(2 * parallelism(units.sparkSession), "unit"))
    counts = units.sparkSession.sparkContext.broadcast(pair_counts(units))
    tried = candidates(units, counts, learn(units, counts, pairs), learn_maps(pairs), True)
    known = units.select(F.col("unit").alias("restored"), F.col("n").alias("n_restored"))
    judged = tried.join(known, "restored", "left").withColumn("n_restored", F.coalesce("n_restored", F.lit(0)))
    marks = lambda c: F.length(F.regexp_replace(c, r"[\x00-\x7F]++", ""))
    wordy = F.regexp_extract("unit", CORE, 0).rlike(STRONG)
    strong = wordy | (marks("restored") < marks("unit"))
    much = F.col("n_restored") >= MUCH * F.col("n")
    between = F.col("unit").rlike(r"[A-Za-z] .* [A-Za-z]")
    beside = F.col("unit").rlike(r"^[A-Za-z0-9]++ ?+[^\x00-\x7F]|[^\x00-\x7F] ?+[A-Za-z0-9]++$")
    weak = (between & much) | (beside & (F.col("n_restored") >= MUCH_ALONE * F.col("n")))
    ok = judged.filter(F.when(strong, (F.col("gain") >= GAIN / 2) & (much | (F.col("gain") >= GAIN))).otherwise(weak))
    order = F.struct(much.alias("m"), "n_restored", "gain", "restored", (F.col("decoded") == "aligned").alias("a"), "decoded", "written")
    best = ok.withColumn("sure", strong | (between & much) | F.col("unit").rlike(LOST)).groupBy("unit").agg(F.max_by(F.struct("restored", "decoded", "written", "sure"), order).alias("b"))
    row = "unit string, restored string, decoded string, written string, sure boolean"
    got = best.select("unit", F.when(~F.col("b.restored").contains("\ufffd"), F.col("b.restored")).alias("restored"), "b.decoded", "b.written", "b.sure")
    got = got.unionByName(pairs.mapInPandas(_dropped, row))
    lost = units.filter(F.col("unit").rlike(LOST)).select("unit", F.lit(None).cast("string").alias("restored"), F.lit("").alias("decoded"), F.lit("").alias("written"), F.lit(True).alias("sure"))
    every = got.unionByName(lost).groupBy("unit").agg(F.max(F.struct("restored", "decoded", "written", "sure")).alias("b"))
    return durable(every.join(units, "unit").select("unit", "n", "b.restored", "b.decoded", "b.written", "b.sure"))


def with_garbled(units: DataFrame, bad: DataFrame) -> DataFrame:
    """doc_id and unit with what is known of the unit, if it is garbled.

    A unit that at least a thousandth of all (doc_id, unit) rows with garbled units hold is broadcast;
    there can be no more than 1,000 of these. The rest is joined by unit, where none is hot.
    """
    total = bad.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = (F.col("n") * 1000 >= total) & (F.length("unit") <= 1024)
    known = F.broadcast(bad.filter(hot))
    rest = bad.filter(~hot)
    return units.join(known, "unit").unionByName(units.join(F.broadcast(bad.filter(hot).select("unit")), "unit", "left_anti").join(rest, "unit"))


def affected(documents: DataFrame) -> DataFrame:
    """doc_id and the garbled units of each document that has a sure one; lone symbols beside numbers only are not sure."""
    by_doc = doc_units(documents)
    bad = garbled_units(by_doc)
    units = by_doc.select("doc_id", F.explode("units").alias("unit"))
    shown = bounded_broadcast(bad)
    units = units.join(shown, "unit") if shown is not bad else with_garbled(units, bad)
    units = units.groupBy("doc_id").agg(F.max("sure").alias("any"), F.collect_set(F.struct("unit", "restored", "decoded", "written")).alias("units"))
    return units.filter("any").select("doc_id", "units")


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document that holds garbled text."""
    return affected(documents).select("doc_id")


def restore(documents: DataFrame) -> DataFrame:
    """doc_id, text, restored_text, status of each affected document.

    Garbled units are replaced where they stand as whole units; digits keep their place. status is
    restored if every garbled unit of the document could be had back, else marked: what is left stays
    as it was.
    """
    df = documents.select("doc_id", "text").join(affected(documents), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fixed = [_apply(t, units) for t, units in zip(pdf["text"], pdf["units"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pdf["text"], "restored_text": [a for a, _ in fixed], "status": ["restored" if ok else "marked" for _, ok in fixed]})

    return df.mapInPandas(run, "doc_id bigint, text string, restored_text string, status string")


def _python(pattern: str) -> re.Pattern:
    """A pattern of the JVM for Python, where a class does not nest."""
    return re.compile(pattern.replace(r"[^\x00-\x7F]]", "\x80-\U0010ffff]").replace("[0-9A-Za-z[", "[0-9A-Za-z"))


def unit_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Where the units of a text stand, and what `normal` makes of them."""
    for m in FIND_UNIT.finditer(text):
        found, a, b = m.group(), m.start(), m.end()
        core = FIND_CORE.search(found)
        if IS_STRONG.search(core.group()):
            bare = core.group()
            a += core.start() + len(bare) - len(bare.lstrip("0123456789"))
            b = m.start() + core.end() - (len(bare) - len(bare.rstrip("0123456789")))
        yield a, b, re.sub("[0-9]+", "0", text[a:b])


def _apply(text: str, units) -> tuple[str, bool]:
    known = {u["unit"]: u["restored"] for u in units}
    out, at, done = [], 0, True
    for a, b, unit in unit_spans(text):
        if unit not in known:
            continue
        digits = re.findall("[0-9]+", text[a:b])
        clean = None if known[unit] is None else known[unit].split("0")
        if clean is None or len(clean) != len(digits) + 1:
            done = False
            continue
        out += [text[at:a], clean[0], *(x for pair in zip(digits, clean[1:]) for x in pair)]
        at = b
    return "".join(out) + text[at:], done


FIND_UNIT, FIND_CORE, IS_STRONG = _python(UNIT), _python(CORE), _python(STRONG)
