"""What a SentencePiece model file says, and where a text may be cut without changing its pieces."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

SPACE = "▁"


class Normaliser:
    """What a model does to a text before its pieces: a map from character sequences, the longest first, and the rule for spaces."""

    def __init__(self, charsmap: bytes, one_space: bool, front: bool):
        self.one_space, self.front = one_space, front
        self.map = self._compiled(charsmap) if charsmap else {}
        self.longest = max(map(len, self.map), default=0)
        starts = {k[0] for k in self.map}
        self.touched = re.compile("[" + "".join(re.escape(c) for c in sorted(starts)) + "]") if starts else None

    @staticmethod
    def _compiled(blob: bytes) -> dict[str, str]:
        """The sequences of a double-array trie and what they become."""
        size = struct.unpack_from("<I", blob)[0]
        units, strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
        offset = lambda u: u >> 10 << ((u & 1 << 9) >> 6)
        out, todo = {}, [(offset(units[0]), b"")]
        while todo:
            node, path = todo.pop()
            for c in range(1, 256):
                at = node ^ c
                if at < len(units) and units[at] & 0x800000FF == c:
                    below = at ^ offset(units[at])
                    if units[at] >> 8 & 1:
                        begin = units[below] & 0x7FFFFFFF
                        out[path + bytes([c])] = strings[begin : strings.index(b"\0", begin)]
                    todo.append((below, path + bytes([c])))
        return {k.decode(): v.decode() for k, v in out.items()}

    def mapped(self, text: str) -> list[str]:
        """The text in parts, each as what it becomes."""
        out, i = [], 0
        while i < len(text):
            found = self.touched.search(text, i) if self.touched else None
            if not found:
                out += text[i:]
                break
            j = found.start()
            out += text[i:j]
            for k in range(min(self.longest, len(text) - j), 0, -1):
                if (to := self.map.get(text[j : j + k])) is not None:
                    out.append(to)
                    i = j + k
                    break
            else:
                out.append(text[j])
                i = j + 1
        return out

    def __call__(self, text: str) -> str:
        """The normalised text, spaces as U+2581, with one in front if the model has it."""
        text = "".join(self.mapped(text)) if self.map else text
        if self.one_space:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.front else text


class Model:
    """Pieces of a model by kind, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.is_bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        spec = proto.normalizer_spec
        if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only models with spaces in front of words and no symbols of their own are compiled")
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix)

    @property
    def identity(self) -> bool:
        """Whether a text keeps all its characters, with a space in front."""
        n = self.normalise
        return not n.map and not n.one_space and n.front

    @property
    def joined(self) -> set[str]:
        """Two characters that stand side by side in a piece; between any others a text may be cut."""
        return {p[i : i + 2] for p in self.normal for i in range(len(p) - 1)}


def _class(chars: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def cutter(path: str):
    """Splits a word (a run of spaces, then others; spaces as U+2581) into segments that are encoded alike alone.

    A segment ends between two characters that no piece holds side by side: a merge never joins
    across them. Letters that any piece joins stay together.
    """
    joined = model(path).joined
    ascii_letters = {chr(c) for c in (*range(65, 91), *range(97, 123))}
    plain = ascii_letters | {c for pair in joined for c in pair if c.isalpha()}
    runs = re.compile(f"{SPACE}*{_class(plain)}+|{SPACE}+|[^{SPACE}]")

    def cut(word: str) -> list[str]:
        parts = runs.findall(word)
        out = [parts[0]] if parts else []
        for part in parts[1:]:
            if out[-1][-1] + part[0] in joined:
                out[-1] += part
            else:
                out.append(part)
        return out

    return cut
