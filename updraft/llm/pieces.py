"""Token ids of whole texts from a ``tokenizers`` file, encoding repeated pieces once.

A byte-level pre-tokenizer never joins the two sides of these places: before a space
or line feed that a non-space follows, and between a letter or digit and a mark of
punctuation. So a text may be cut there, and the ids of its pieces are the ids of the
text. Texts are cut and their pieces counted into a dictionary by Arrow; only distinct
pieces that the worker's bounded cache lacks are given to the library, many to a call.

With ``literal`` the content of a special token in a text is encoded like any other characters. Without,
it becomes that token, as the library does it, and such a text is encoded uncut.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from updraft.llm.words import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

GENERATION = 250_000
GROUP_BYTES = 4 << 20
JOINED = 256
MARK = "\x1f"
ANY_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
ODD = rf"[ \n](?:[{ANY_SPACE}]|$)"
BEFORE_SPACE = rf"([ \n])([^{ANY_SPACE}])"
# Latin letters and digits; ASCII punctuation but the apostrophe.
BEFORE_MARK = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~])"
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def cut(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its pieces."""
    if pc.any(pc.match_substring_regex(texts, ODD)).as_py():
        texts = pc.replace_substring_regex(texts, BEFORE_SPACE, rf"{MARK}\1\2")
    else:
        texts = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n")
    return pc.split_pattern(pc.replace_substring_regex(texts, BEFORE_MARK, rf"\1{MARK}\2"), MARK)


def parted(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids from each start to its end; the last part has no end but that of ``ids``."""
    data = ids.tobytes()
    return [data[a:b] for a, b in zip((4 * starts).tolist(), [*(4 * ends).tolist(), len(data)])]


class PieceEncoder:
    """Encodes Arrow arrays of texts to unsigned 32-bit ids."""

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = self.tokenizer.get_added_tokens_decoder().values()
        # With ``literal`` only tokens that are not special are still found in texts.
        self.added = [t.content for t in added if not (literal and t.special)]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Both share the model. Letters alone after a space are one pre-token, so a cut at spaces is all they need;
        # other pieces are joined by the mark, which none of them holds.
        self.words, self.marked = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.marked.pre_tokenizer = Sequence([Split(MARK, "isolated"), self.tokenizer.pre_tokenizer])
        self.between = self.whole([MARK], "marked")[0]
        self.spaced = np.zeros(self.vocabulary, dtype=bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.startswith("Ġ")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, literal: bool = True) -> PieceEncoder:
        """The encoder of this worker process."""
        if (path, literal) not in _encoders:
            _encoders[path, literal] = cls(path, literal)
        return _encoders[path, literal]

    def forget(self) -> None:
        """Empties the cache and gives memory back, so that a worker kept for other work holds no more than the vocabulary."""
        self.young, self.old = {}, {}
        give_back()

    def whole(self, texts: list[str], by: str = "tokenizer") -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in getattr(self, by).encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces are encoded many to a text: those of a space and a word part again at each space, others at the mark."""
        joinable, others = [], []
        for p in pieces:
            (joinable if p[:1] == " " and p[1:].isalpha() else others).append(p)
        for group, ids in self.joined(joinable, "", "words"):
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(group):
                yield from zip(group, parted(ids, at, at[1:]))
            else:
                others.extend(group)
        for group, ids in self.joined(others, MARK, "marked"):
            at = np.flatnonzero(ids == self.between[0]) if len(self.between) == 1 else ids[:0]
            if len(at) == len(group) - 1:
                yield from zip(group, parted(ids, np.concatenate([[0], at + 1]), at))
            else:
                yield from zip(group, (ids.tobytes() for ids in self.whole(group)))

    def joined(self, pieces: list[str], between: str, by: str) -> Iterator[tuple[list[str], np.ndarray]]:
        """Groups of pieces with the ids of each group's pieces, joined to one text."""
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        return zip(groups, self.whole([between.join(g) for g in groups], by))

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those not used for a while leave the cache."""
        found = list(map(self.young.get, pieces))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if absent:
            wanted = [pieces[i] for i in absent]
            known = list(map(self.old.get, wanted))
            fresh = dict(self.fresh([p for p, ids in zip(wanted, known) if ids is None]))
            if len(self.young) + len(wanted) > GENERATION:
                self.old, self.young = self.young, {}
            young = self.young
            for i, p, ids in zip(absent, wanted, known):
                found[i] = ids = fresh[p] if ids is None else ids
                if len(p) <= 64:
                    young[p] = ids
        return found

    def encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = cut(texts)
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy()
        known = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        own = sizes[index]
        ends = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
        # From a piece's place in the ids of the group to its place among the distinct ones.
        at = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[index] - ends[:-1], own)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], np.diff(ends[lists.offsets.to_numpy()])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; NULL counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        marked = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        uncut = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            uncut |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        marked = marked | uncut
        first = 0
        while first < len(texts):
            if marked[first] or sizes[first] > GROUP_BYTES:
                text = texts[first].as_py()
                yield self.whole([text])[0] if uncut[first] else self.long(text)
                first += 1
                continue
            last, total = first, 0
            while last < len(texts) and not marked[last] and total + sizes[last] <= GROUP_BYTES:
                total += sizes[last]
                last += 1
            ids, own = self.encode_group(texts[first:last])
            yield from np.split(ids, np.cumsum(own)[:-1])
            first = last

    def long(self, text: str) -> np.ndarray:
        """A text longer than a group, or one with the mark, slice by slice between pieces."""
        parts, at, step = [], 0, GROUP_BYTES // 4
        while at < len(text):
            to = at + step
            while to < len(text) and not (text[to] == " " and text[to + 1 : to + 2].isalnum()):
                to = text.find(" ", to + 1)
                to = len(text) if to < 0 else to
            part = text[at:to]
            if MARK in part:
                parts.extend(self.whole([part]))
            else:
                parts.append(self.encode_group(pa.array([part], pa.string()))[0])
            at = to
        return np.concatenate(parts) if parts else np.empty(0, "<u4")
