"""Token ids of whole texts, with the ids of space-separated chunks remembered.

In the byte-level pattern a space before a character that is no white space always starts a token, so
what lies between such spaces is encoded alone and once. A text in which some space is followed by
white space, or by nothing, is encoded whole; both ways give the ids of the tokenizer itself.
"""

from __future__ import annotations

import array
import json
import re
import sys

_LOOSE = re.compile(r" (?:\s|\u180e|\Z)")
_made: dict[int, "ChunkEncoder"] = {}

#: Fixed value: the pattern by which byte-level tokenizers of this family cut texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Which byte each printable stand-in of a byte-level vocabulary means: itself where printable, else counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _core(told: dict):  # noqa: ANN202
    """A function from ordinary text to ids, by a faster library where the file asks for nothing that it lacks; else None."""
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    same = model.get("type", "BPE") == "BPE" and not told.get("normalizer") and not any((model.get(k) or v) != v for k, v in plain.items())
    same = same and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    byte, special = _byte_of(), {t["content"] for t in told.get("added_tokens", [])}
    words = sorted(((i, w) for w, i in model["vocab"].items() if w not in special))
    single, merged = words[:256], words[256:]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    # ids are ranks only if every single byte comes first and merges follow in the order of their ids
    if not same or {w for _, w in single} != set(byte) or [w for _, w in merged] != made:
        return None
    import tiktoken

    ranks = {bytes(byte[c] for c in w): i for i, w in words}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ChunkEncoder:
    """Encode to bytes of little-endian unsigned 32-bit ids, those of the `tokenizers` library without added special tokens.

    Strings of the file's added tokens within a text get their ids, and part what is around them, as in that library;
    with `special_as_text` they are ordinary text. A file whose ids aren't plain byte-level merge ranks,
    or whose added tokens ask for more than their string, is left to that library.
    `most` bounds the memory of remembered chunks, not what is encoded.
    """

    def __init__(self, tokenizer_json: str, most: int = 250_000, special_as_text: bool = False):
        told = json.loads(tokenizer_json)
        added = told.get("added_tokens", [])
        simple = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        core = _core(told) if simple or special_as_text else None
        self.whole = core is None
        if self.whole:
            from tokenizers import Tokenizer

            other = Tokenizer.from_str(tokenizer_json)
            other.encode_special_tokens = special_as_text
            core = lambda text: other.encode(text, add_special_tokens=False).ids
        self._plain = plain = lambda text: _little(core(text))
        self._added = {t["content"]: _little([t["id"]]) for t in added} if not self.whole and not special_as_text else {}
        self._parts = re.compile("(" + "|".join(re.escape(w) for w in sorted(self._added, key=len, reverse=True)) + ")") if self._added else None

        class Known(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = self[chunk] = plain(chunk)
                return ids

        self.most, self.known = most, Known()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._parts is not None and self._parts.search(text):
            return b"".join(self._added.get(part) or self._text(part) for part in self._parts.split(text) if part)
        return self._text(text)

    def _text(self, text: str) -> bytes:
        if self.whole or "\0" in text or _LOOSE.search(text):
            return self._plain(text)
        if len(self.known) > self.most:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.replace(" ", "\0 ").split("\0")))


def _little(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encoder(tokenizer_json: str) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _made:
        _made[key] = ChunkEncoder(tokenizer_json)
    return _made[key]


def read_tokenizer(path: str | None) -> str:
    """The tokenizer file's text, for tasks to get in their closure's broadcast; a file of about 2 MB, whatever the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
