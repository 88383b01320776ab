"""Encoding and decoding with a given BPE file, word by word with a bounded cache.

The tokenizer must cut its input at white space and never look across it (its normalizer and
its pre-tokenizer then treat each run of non-space by itself); `separable` checks that for a
tokenizer file, and Encoder encodes whole texts where it doesn't hold.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import xxhash

from parchmint.llm.shingles import mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each task

from tokenizers import Tokenizer  # noqa: E402

CACHE_WORDS = 450_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def loaded(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def separable(path: str) -> bool:
    """Whether encoding runs of non-space one by one gives what encoding the whole text gives."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in first.get("pattern", {}).get("Regex", "")
    plain = all(not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return bool(drops and plain and spec["model"]["type"] == "BPE" and not spec.get("post_processor"))


#: Bytes of text that are worked on at once.
BATCH_BYTES = 2 << 20


def pieces(text: bytes, most: int) -> list[bytes]:
    """A text in parts that begin at ASCII spaces, of `most` bytes unless a word is longer."""
    out, start = [], 0
    while len(text) - start > most:
        cut = max(text.rfind(c, start + 1, start + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            cut = min((i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, start + most)) >= 0), default=len(text))
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


#: Letters that lower-casing and NFC leave alone, or only lower-case, each by itself.
PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz".decode()) | {chr(c) for c in range(0xDF, 0x100) if c != 0xF7}
MARKS = b".,!?;:|"
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Kinds of bytes: 0 space, 1 a-z, 2 ends a PLAIN letter after 0xC3, 3 a mark, 4 others.
KINDS = np.full(256, 4, dtype=np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[97:123] = 1
KINDS[0x9F:0xC0] = 2
KINDS[0xB7] = 4
KINDS[list(MARKS)] = 3
#: Masks of the first n bytes of eight.
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """encode: UTF-8 to ids as little-endian bytes; decode: ids to text.

    Words of PLAIN letters go to the BPE model itself, since nothing before it would change them
    but their case; all others go through the whole tokenizer. Where a probe of both ways
    disagrees, all words do.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = loaded(path)
        self.by_word = separable(path)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if n <= 65536 else "<u4")
        self.words: dict[bytes, bytes] = {}
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(n)] if self.tokenizer.decoder is None else None
        self.model = Tokenizer(self.tokenizer.model)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(n)])
        self.letters = str.maketrans(byte_letters())
        self.bare = bool(suffix) and self._probe()

    def _probe(self) -> bool:
        """Whether words go to the model alone: tried with every PLAIN letter in three places, and every mark after every letter."""
        letters = sorted(PLAIN)
        words = [w for c in letters for w in (c, f"{c}the", f"the{c}", c + c)] + ["x" * 40, "encyclopaedia", "thingor"]
        upper = [c.upper() for c in letters if len(c.upper()) == 1 and c.upper().lower() == c]
        pairs = [(c, m + more) for c in (*letters, "the") for m in MARKS.decode() for more in ("", "b", m)]
        try:
            alone = self._cores(words) == self._packed(words) and self._cores([c.lower() for c in upper]) == self._packed(upper)
        except ValueError:
            return False
        cut = [b"".join(x) for x in zip(self._packed([a for a, _ in pairs]), self._packed([b for _, b in pairs]), strict=True)]
        return alone and self._packed([a + b for a, b in pairs]) == cut

    def _packed(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cores(self, words: list[str]) -> list[bytes]:
        """Ids of words of PLAIN letters, by the model alone, in one sequence cut at ends of words."""
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        ids = np.array(self.model.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=self.dtype)
        at = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(at) != len(words):
            raise ValueError("words can't be told apart in the model's output")
        packed, starts = ids.tobytes(), [0, *at[:-1].tolist()]
        return [packed[i:j] for i, j in zip(starts, at.tolist(), strict=True)]

    def _learn(self, new: list[bytes], low: bool = False) -> None:
        """Add words to the cache. low: their A-Z are lower-cased already."""
        plain = {}
        if self.bare and low:
            for w in new:
                if w.isalpha():  # ASCII
                    plain[w] = w.decode()
                elif PLAIN.issuperset(lower := w.decode().lower()):
                    plain[w] = lower
        if plain:
            self.words.update(zip(plain, self._cores(list(plain.values())), strict=True))
        other = [w for w in new if w not in plain] if plain else new
        self.words.update(zip(other, self._packed([w.decode() for w in other]), strict=True))

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        split = [x.split() for x in texts]  # at ASCII space alone
        self._learn(list(set().union(*split).difference(self.words)))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def _by_key(self, texts: list[bytes]) -> list[bytes]:
        """As _by_word, with words found, told apart and put together in numpy.

        A-Z are lower-cased first, and a mark right after a plain letter begins a word of its own:
        the tokenizer cuts there as well. A word of up to 16 bytes is its own key.
        """
        ends = np.cumsum([len(x) + 1 for x in texts])
        raw = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), dtype=np.uint8)
        data = LOWERED[raw]
        blob = data.tobytes()
        kind = KINDS[data]
        letter = kind == 1
        letter[1:] |= (kind[1:] == 2) & (data[:-1] == 0xC3)
        inside = kind > 0
        inside[-16:] = False
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (kind[1:] == 3) & letter[:-1]
        at = np.flatnonzero(begins)
        stop = inside.copy()  # the last byte of each word
        stop[:-1] &= ~inside[1:] | begins[1:]
        size = np.flatnonzero(stop) + 1 - at
        lanes = np.ndarray((len(blob) - 7,), dtype="<u8", buffer=blob, strides=(1,))
        one = lanes[at] & HEADS[np.minimum(size, 8)]
        two = lanes[at + 8] & HEADS[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero(size > 16)
        key = mix(one * np.uint64(0x9E3779B97F4A7C15) + two) ^ (size.astype(np.uint64) << np.uint64(56))
        for k in long.tolist():
            key[k] = xxhash.xxh3_64_intdigest(blob[at[k] : at[k] + size[k]])
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        same = first[place]
        if not ((one == one[same]) & (two == two[same]) & (size == size[same])).all() or any(blob[at[k] : at[k] + size[k]] != blob[at[j] : at[j] + size[j]] for k, j in zip(long.tolist(), same[long].tolist(), strict=True)):
            return self._by_word(texts)  # two words with one key
        words = [blob[i : i + n] for i, n in zip(at[first].tolist(), size[first].tolist(), strict=True)]
        self._learn([w for w in words if w not in self.words], low=True)
        found = list(map(self.words.__getitem__, words))
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        start = np.cumsum(length) - length
        n = length[place]
        end = np.cumsum(n)
        ids = self.ids(b"".join(found))[np.arange(n.sum()) + np.repeat(start[place] - (end - n), n)].tobytes()
        cuts = np.concatenate(([0], end))[np.searchsorted(at, ends)] * self.dtype.itemsize
        return [ids[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """One packed id sequence for each text, at most BATCH_BYTES of text at a time."""
        if not self.by_word:
            return self._packed([x.decode() for x in texts])
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            if size + len(text) > BATCH_BYTES:
                out += self._encoded(held)
                held, size = [], 0
            if len(text) > BATCH_BYTES:  # a long text is cut at spaces
                out.append(b"".join(x for piece in pieces(text, BATCH_BYTES) for x in self._encoded([piece])))
            else:
                held.append(text)
                size += len(text)
        return out + self._encoded(held)

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if not self.bare or sum(map(len, texts)) < 4096 or any(b"<|" in x or b"\0" in x for x in texts):
            return self._by_word(texts)
        return self._by_key(texts)

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        if self.names is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
