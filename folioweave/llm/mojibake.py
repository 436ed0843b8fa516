"""Text that was decoded with the wrong character encoding: finding it and restoring it.

Clean rows of a bounded sample are garbled on purpose by every known encoding chain, and a
multinomial model of hashed byte bigrams learns which chain a word looks like. A word is garbled if the
model prefers a chain to "clean"; that chain is inverted, and the word is only restored if every step back
decodes strictly. Nothing but the model's scores tells a garbled word from a clean one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that the model is trained on; the rest of the data is only scored.
TRAIN_ROWS = 8000
BUCKETS = 1 << 14
#: Log-probability of a word being garbled by any one chain, against being clean: what a model must make up for.
PRIOR = -2.0

# Encoding chains, each the encodings that a text was written in and then read in, in turn.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "latin-1"),),
    (("utf-8", "sloppy-1252"),),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "sloppy-1252"), ("utf-8", "sloppy-1252")),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "koi8_r"),),
    (("utf-8", "cp949"),),
    (("cp1251", "latin-1"),),
    (("cp1251", "sloppy-1252"),),
    (("koi8_r", "latin-1"),),
    (("euc_kr", "latin-1"),),
    (("euc_kr", "sloppy-1252"),),
    (("sloppy-1252", "utf-8"),),
    (("euc_kr", "utf-8"),),
    (("cp1251", "utf-8"),),
)


def encode(text: str, codec: str) -> bytes:
    """Strict encoding; ``sloppy-1252`` is cp1252 whose five free bytes are control characters."""
    if codec != "sloppy-1252":
        return text.encode(codec)
    return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)


def decode(raw: bytes, codec: str, errors: str = "strict") -> str:
    if codec != "sloppy-1252":
        return raw.decode(codec, errors)
    return "".join(bytes([b]).decode("cp1252" if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else "latin-1") for b in raw)


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after a chain, or None where the chain can't hold it."""
    try:
        for write, read in chain:
            text = decode(encode(text, write), read, "replace")
    except UnicodeError:
        return None
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before a chain, or None where a step back doesn't decode strictly."""
    try:
        for write, read in reversed(chain):
            text = decode(encode(text, read), write)
    except UnicodeError:
        return None
    return text


def plausible(text: str) -> bool:
    """Restored text: printable, in the blocks that books are set in, and of one alphabet only."""
    alphabets = set()
    for c in text:
        if c.isascii():
            if c < " " or c == "\x7f":
                return False
            if c.isalpha():
                alphabets.add("latin")
        elif c.isalpha():
            if c <= "ſ" or c in "ȘșȚțſƒªº":
                alphabets.add("latin")
            elif "Ѐ" <= c <= "ӿ":
                alphabets.add("cyrillic")
            elif "가" <= c <= "힣" or "一" <= c <= "鿿" or "ㄱ" <= c <= "ㆎ":
                alphabets.add("korean")
            elif c in "µσαβγδεζηθικλμνξοπρςτυφχψωΓΔΘΛΞΠΣΦΨΩ":
                alphabets.add("greek")
            else:
                return False
        elif not ("\xa0" <= c <= "ÿ" or "\u2000" <= c <= "⯿" or "　" <= c <= "㏿" or c in "\ufeff"):
            return False
    return len(alphabets - {"greek"}) <= 1 or alphabets == {"latin", "korean"}


def hashed(raw: bytes) -> np.ndarray:
    """Buckets of the byte bigrams of a byte string."""
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    return (x[:-1] * 257 + x[1:] * 131 + x[:-1] * x[1:]) % BUCKETS


def features(word: str) -> np.ndarray:
    return hashed(b"\x02" + word.encode("utf-8", "replace") + b"\x03")


def special_words(text: str) -> list[str]:
    """Words with a character beyond ASCII; only plain blanks part words, for wrong decoding makes others."""
    return [w for w in re.split(r"[ \t\n]+", text) if not w.isascii()]


def _counts(words: list[str]) -> np.ndarray:
    """How often each bucket occurs in the words; pairs across two words are left out."""
    raw = "".join(f"\x02{w}\x03" for w in words).encode("utf-8", "replace")
    if not raw:
        return np.zeros(BUCKETS)
    across = np.frombuffer(raw[:-1], dtype=np.uint8) == 3
    return np.bincount(hashed(raw)[~across], minlength=BUCKETS).astype(float)


def train(rows: list[str], passes: int = 2) -> np.ndarray:
    """Log-probabilities [clean, *chains] x buckets.

    The sample holds garbled rows too. The second pass leaves out what the first one finds.
    """
    clean, table = rows, None
    for _ in range(passes):
        beyond = [t for t in clean if not t.isascii()]
        garbled = [[g for t in beyond if (g := garble(t, chain)) is not None and g != t] for chain in CHAINS]
        counts = np.stack([_counts([w for t in texts for w in special_words(t)]) for texts in (beyond, *garbled)]) + 0.05
        table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        judge = Judge(table)
        clean = [t for t in rows if not judge.row(t)[0]]
    return table


#: Chains that lose bytes, and those that can be undone.
LOSSY = [k for k, c in enumerate(CHAINS, 1) if c[-1][1] in ("utf-8", "cp949")]
EXACT = [k for k, c in enumerate(CHAINS, 1) if c[-1][1] != "utf-8"]


class Judge:
    """Scores words with a trained table; words recur, so verdicts are remembered."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.known: dict[tuple[str, bool], tuple[str | None, int, bool]] = {}

    def scores(self, w: str) -> np.ndarray:
        s = self.table[:, features(w)].sum(axis=1)
        s[1:] += PRIOR
        return s

    def word(self, w: str, part: bool = False) -> tuple[str | None, int, bool]:
        """(restored word or None, chain, sure): chain 0 for clean.

        Of the chains that score above "clean" the best one counts that can be undone strictly to a plausible text;
        failing that, a word with lost bytes or with control characters is garbled beyond repair by the best chain. ``part``: a run within a word,
        which stands for itself and not for the word's beginning and end.
        """
        if (w, part) in self.known:
            return self.known[w, part]
        scores = self.scores(w)
        order = [k for k in np.argsort(-scores, kind="stable").tolist() if k and scores[k] > scores[0]]
        out = (None, 0, True)
        for k in order:
            if k in EXACT and (got := restore(w, CHAINS[k - 1])) is not None and got != w and self.fits(w, got, k):
                out = (got, k, self.sure(got, k))
                break
        if not out[1] and order and ("\ufffd" in w or any("\x80" <= c <= "\x9f" for c in w)):
            out = (None, next((k for k in order if k in LOSSY), order[0]) if "\ufffd" in w else order[0], True)
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[w, part] = out
        return out

    @staticmethod
    def fits(w: str, got: str, k: int) -> bool:
        """Whether what a chain gives back is text that it could have been made from."""
        write = CHAINS[k - 1][0][0]
        if not plausible(got):
            return False
        if write == "euc_kr":
            return all(c.isascii() or "가" <= c <= "힣" for c in got)
        if write in ("cp1251", "koi8_r"):
            return not any(c.isascii() and c.isalpha() for c in w) and all(c.isascii() or "Ѐ" <= c <= "ӿ" or c in "«»—–№ " for c in got)
        return True

    @staticmethod
    def sure(got: str, k: int) -> bool:
        """Short words in a one-byte alphabet may be anything: they need a longer one beside them."""
        beyond = sum(not c.isascii() for c in got)
        return beyond > {"euc_kr": 1, "cp1251": 3, "koi8_r": 3}.get(CHAINS[k - 1][0][0], 0)

    def runs(self, w: str) -> tuple[str, int]:
        """A word that is garbled in part: its runs beyond ASCII judged one by one; the chain of the first that is garbled, else 0."""
        found = 0

        def one(m: re.Match) -> str:
            nonlocal found
            restored, chain, sure = self.word(m.group(), part=True)
            if not chain or not sure or restored is None or CHAINS[chain - 1][0][0] != "utf-8" or not plausible(w.replace(m.group(), restored)):
                return m.group()
            found = found or chain
            return restored

        return re.sub(r"[^\x00-\x7f]{2,}", one, w), found

    def row(self, text: str) -> tuple[bool, str, bool, int]:
        """(garbled, text with restored words, wholly restored, chain number of the first garbled word)."""
        parts = re.split(r"([ \t\n]+)", text)
        found: dict[int, tuple[str | None, int]] = {}
        doubtful: dict[int, tuple[str | None, int]] = {}
        for n in range(0, len(parts), 2):
            w = parts[n]
            if w.isascii():
                continue
            restored, chain, sure = self.word(w)
            if chain == 0 or not sure:
                fixed, part = self.runs(w)
                if part:
                    restored, chain, sure = fixed, part, True
            if chain:
                (found if sure else doubtful)[n] = (restored, chain)
        # a word of one or two characters only counts beside a longer one that went the same way
        ways = {c for _, c in found.values()}
        writes = {CHAINS[c - 1][0][0] for c in ways}
        for n, (restored, chain) in doubtful.items():
            if CHAINS[chain - 1][0][0] in writes:
                found[n] = (restored, chain)
        for k in ways:
            if CHAINS[k - 1][0][0] in ("cp1251", "koi8_r"):
                for n in range(0, len(parts), 2):
                    w = parts[n]
                    if n not in found and not w.isascii() and not any(c.isascii() and c.isalpha() for c in w):
                        got = restore(w, CHAINS[k - 1])
                        if got and plausible(got):
                            found[n] = (got, k)
        if not found:
            return False, text, False, 0
        for n, (restored, _) in found.items():
            parts[n] = parts[n] if restored is None else restored
        whole = all(r is not None for r, _ in found.values())
        return True, "".join(parts), whole, found[min(found)][1]


def find(rows: DataFrame, keys: list[str], text: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(keys, text, repaired, recoverable, chain) of the rows that hold wrongly decoded characters.

    ``repaired`` has every word back that decodes strictly and leaves the others; ``recoverable``
    says that none was left. Null, empty and plain ASCII texts are no case. Rows repeated under
    one key count once. The sample is the first ``train_rows`` rows in the order of their text's
    hash, the only rows that reach the driver.
    """
    some = rows.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(*keys, text).dropDuplicates(keys)
    sample = some.select(text).distinct().orderBy(F.xxhash64(text), text).limit(train_rows)
    table = train([r[0] for r in sample.collect()])
    broadcast = rows.sparkSession.sparkContext.broadcast(table)
    names = ["+".join(f"{a}>{b}" for a, b in c) for c in CHAINS]

    @F.pandas_udf("garbled boolean, repaired string, recoverable boolean, chain string")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(broadcast.value)
        for s in texts:
            out = [judge.row(t) for t in s]
            yield pd.DataFrame(
                {
                    "garbled": [o[0] for o in out],
                    "repaired": [o[1] for o in out],
                    "recoverable": [o[2] for o in out],
                    "chain": [names[o[3] - 1] if o[0] else None for o in out],
                }
            )

    return some.withColumn("j", judged(text)).where("j.garbled").select(*keys, text, "j.repaired", "j.recoverable", "j.chain")
