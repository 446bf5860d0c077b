"""Token ids of texts by the tokenizers library, word by word.

The vocabularies used here end a token at white space, so that a text's ids are the ids of its parts
between spaces and line ends, in order; and letters and signs never share a token, so that a part such as
``word,`` is ``word`` and ``,``. A part of at most ``SHORT`` characters is encoded once in a Python worker and remembered
(at most ``REMEMBERED`` of them, about 200 bytes each), which spares the library most of the work on ordinary text; longer
parts, such as texts without spaces, are encoded and forgotten. ``encoder`` asks the tokenizer file whether this
holds and otherwise encodes whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

REMEMBERED, SHORT = 400_000, 32
SIGNS = ",.;:!?|*%&$#"
_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _by_parts(spec: dict) -> bool:
    """Whether the tokenizer drops white space, ignores case, and keeps letters, digits and signs apart."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = str(spec.get("normalizer"))
    pattern = str(parts[0].get("pattern"))
    apart = parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    apart = apart and "[\\p{L}]+" in pattern.replace("\\\\", "\\") and "[^\\s\\p{L}\\p{N}]+" in pattern.replace("\\\\", "\\")
    return apart and "Lowercase" in normal and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))


def _core(part: str) -> str:
    """``part`` without the signs after a last ASCII letter, in lower case if it is ASCII and no special token."""
    core = part.rstrip(SIGNS)
    last = core[-1:]  # ASCII, since some other letters become several in lower case, the last of them no letter
    if len(core) == len(part) or not (last.isascii() and last.isalpha()):
        core = part
    return core.lower() if core.isascii() and "<" not in core else core


class Encoder:
    """Ids of texts, without special tokens added, and what a worker remembers of parts it has met."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.mark = next((t for t in spec.get("added_tokens", []) if t["special"]), None)
        self.by_parts = self.mark is not None and _by_parts(spec)
        ends = spec["model"].get("end_of_word_suffix") or "</w>"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(ends)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _several(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of many parts, encoded many at a time: words between spaces, others between special tokens."""
        words, rest = [p for p in parts if p.isalpha()], [p for p in parts if not p.isalpha()]
        for own, between in ((words, " "), ([p for p in rest if "<" not in p], self.mark["content"])):
            for at in range(0, len(own), 500):
                some = own[at : at + 500]
                ids = self.plainly([between.join(some)])[0]
                if between == " ":
                    starts = [0, *(np.flatnonzero(self.closes[ids]) + 1).tolist()]
                    ends = starts[1:]
                    starts.pop()
                else:
                    ends = [*np.flatnonzero(ids == self.mark["id"]).tolist(), len(ids)]
                    starts = [0, *(e + 1 for e in ends[:-1])]
                if len(starts) != len(some):  # a sign that joins or parts words in a way unforeseen
                    yield from ((p, i.tobytes()) for p, i in zip(some, self.plainly(some), strict=True))
                    continue
                raw = ids.tobytes()
                yield from ((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, starts, ends, strict=True))
        odd = [p for p in rest if "<" in p]
        yield from ((p, i.tobytes()) for p, i in zip(odd, self.plainly(odd), strict=True))

    def _look(self, part: str) -> bytes | None:
        ids = self.old.get(part)
        if ids is not None:
            self.young[part] = ids
        return ids

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each of some distinct parts, as bytes of int32."""
        if len(self.young) > self.remembered // 2:
            self.old, self.young = self.young, {}
        found = [self.young.get(p) for p in parts]
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = self._look(parts[k])
        missing = [k for k in missing if found[k] is None]
        if missing:
            cores = {k: _core(parts[k]) for k in missing}
            wanted = {*cores.values(), *(parts[k][len(c) :] for k, c in cores.items())}
            fresh: dict[str, bytes] = {}
            known = {p: ids for p in wanted if (ids := self.young.get(p) or self._look(p)) is not None}
            for p, ids in self._several([p for p in wanted if p not in known]):
                known[p] = ids
                fresh[p] = ids
            for k, core in cores.items():
                found[k] = known[core] + known[parts[k][len(core) :]]
                fresh[parts[k]] = found[k]
            self.young.update((p, ids) for p, ids in fresh.items() if len(p) <= SHORT)
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and end in it."""
        if not self.by_parts:
            held = self.plainly([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, np.int32), *held]), np.cumsum([0, *map(len, held)])
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else a special token might be made or missed
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([,.!|]+\s)", r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        found = self.parts(coded.dictionary.to_pylist())
        all_ids = np.frombuffer(b"".join(found), np.int32)
        sizes = np.array([len(ids) // 4 for ids in found], np.int64)
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        begin = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        ids = all_ids[np.arange(ends[-1]) + np.repeat(begin, each)] if len(codes) else np.zeros(0, np.int32)
        cuts = lists.offsets.to_numpy().astype(np.int64)
        return ids, ends[cuts - cuts[0]]


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this worker, which keeps what it has learned from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]


def groups(texts: pa.Array, limit: int = 3 << 20) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, rows)`` of runs of texts with about ``limit`` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, texts.slice(first, end - first)
        first = end


def with_end(ids: np.ndarray, cuts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new places."""
    return np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))
