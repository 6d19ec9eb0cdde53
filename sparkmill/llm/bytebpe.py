"""Ids of a byte-level BPE file, whole texts at a time.

The pre-tokenisers of such files always begin a pre-token at a single space that
a non-space follows.  So texts are cut there, each distinct cut of a batch is
encoded once (all in one call: only the first id of a cut starts with a space),
and a text's ids are gathered from its cuts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Letters on whose classes all Unicode versions agree.
_PLAIN = re.compile(r"[\x00-ɏ]*\Z")
#: A space before white space: there a cut would not be a border.
_ODD = tuple(" " + c for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0")
AT_ONCE = 16 << 20
#: White space of this length or more fills such a window of the text; the fast way's pattern runs out of stack on a million.
RUN = 10_000


def _long_run(text: str) -> bool:
    """Whether white space may stand RUN characters long: some aligned half of it is then nothing else."""
    half = RUN // 2
    return len(text) >= half and any(text[k : k + half].isspace() for k in range(0, len(text), half))


class _Numbers(dict):
    def __missing__(self, cut: str) -> int:
        self[cut] = n = len(self)
        return n


class Encoder:
    """encode(text) -> uint32 ids, equal to those of the tokenizers library.

    With ``ranks`` and ``pattern`` (the same vocabulary for tiktoken) plain texts
    take that faster way; texts with special strings, rare letters or very long
    white space do not.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.spaced = np.zeros(max(table.values()) + 1, bool)
            self.spaced[[i for b, i in table.items() if b[:1] == b" "]] = True

    def _is_plain(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or bool(_PLAIN.match(text))) and not any(s in text for s in self.special) and not _long_run(text)

    def encode(self, text: str) -> np.ndarray:
        ids = self.fast.encode_ordinary(text) if self._is_plain(text) else self.library.encode(text, add_special_tokens=False).ids
        return np.frombuffer(array("I", ids), np.uint32)

    def cuts(self, text: str) -> list[str] | None:
        """What stands before and between spaces; None where such cuts are no borders of pre-tokens."""
        if not self._is_plain(text) or text[-1:] == " " or any(s in text for s in _ODD):
            return None
        return text.split(" ")

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null is empty."""
        start, held = 0, 0
        for k, text in enumerate(texts):
            held += len(text or "")
            if held >= AT_ONCE or k + 1 == len(texts):
                yield from self._encode_some(texts[start : k + 1])
                start, held = k + 1, 0

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        known, found = _Numbers(), []
        for text in texts:
            cuts = self.cuts(text or "")
            if cuts is None:
                found.append(text)
            else:
                found.append((self.encode(cuts[0]), np.fromiter(map(known.__getitem__, cuts[1:]), np.int32, len(cuts) - 1)))
        flat = self.encode(" " + " ".join(known)) if known else np.empty(0, np.uint32)
        starts = np.flatnonzero(self.spaced[flat]) if known else np.empty(0, np.int64)
        if len(starts) != len(known):
            return [self.encode(t or "") for t in texts]
        sizes = np.diff(starts, append=len(flat))
        return [self.encode(f) if isinstance(f, str) else np.concatenate([f[0], _gathered(flat, starts[f[1]], sizes[f[1]])]) for f in found]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def pack_ids(ids: np.ndarray, level: int = 1) -> bytes:
    """Ids in as few bytes each as all need, compressed."""
    import zstandard

    small = not len(ids) or int(ids.max()) < 1 << 16
    return bytes([2 if small else 4]) + zstandard.ZstdCompressor(level=level).compress(ids.astype("<u2" if small else "<u4").tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.uint32)


_encoders: dict = {}


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each worker process and file."""
    key = (path, ranks, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, ranks, pattern)
    return _encoders[key]


def byte_bpe_50k() -> tuple[str, str, str]:
    """The three parameters of encoder() for the vocabulary of 50,257 ids."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
