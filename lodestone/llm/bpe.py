"""BPE encoding and decoding with tree concatenation.

Short texts are encoded whole (by their stretches between spaces, where the
tokenizer drops these; see ``Pieces``). A text of more than ``block`` characters is cut
into blocks, whose encodings are joined pairwise up a tree; those of a text of
more than ``deal`` characters are encoded in parallel, dealt over all tasks. Around each join a window is re-encoded, and it grows until
both sides agree exactly: the window must start on a token of the left side and
repeat that side's next tokens, and must reach a token of the right side and
repeat that side's following tokens, with the same word borders. What lies
between is the window's. If no window agrees, the two sides are encoded as one
text, so the result never depends on the cuts.

Why agreement is enough: the pre-tokenizer scans from left to right without
looking back, so two scans that share a word border go on alike; within a word
a sequence of tokens is the encoding if each neighbouring pair is, and each
pair of the joined sequence stands in an encoding that was made whole.

Cases: null counts as the empty text (no ids; the hashes are of no bytes).
Repeated rows are encoded each; an empty table gives an empty result; extra
columns are not read. Strings of special tokens within a text become these
tokens, as in the library's own default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block; texts of more characters than DEAL have their blocks dealt over all tasks, shorter ones are cut and joined in one.
BLOCK, DEAL = 1 << 13, 1 << 16
#: Normalizer, pre-tokenizer, post-processor and decoder of the tokenizers whose texts may be encoded stretch by stretch (fixed values).
KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
    None,
)
#: Tokens on which both sides of a join must agree in a row.
AGREE = 6


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Part:
    """A stretch of text with its ids, each token's first character and word number."""

    def __init__(self, text: str, ids: np.ndarray, at: np.ndarray, end: np.ndarray, word: np.ndarray):
        self.text, self.ids, self.at, self.end, self.word = text, ids, at, end, word

    @classmethod
    def of(cls, tok, text: str) -> Part:
        return cls.from_encoding(text, tok.encode(text, add_special_tokens=False))

    @classmethod
    def from_encoding(cls, text: str, e) -> Part:
        off = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        word = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        return cls(text, np.array(e.ids, dtype=np.uint32), off[:, 0], off[:, 1], word)

    def borders(self) -> np.ndarray:
        """True for tokens that begin a word, by word number (a special token is a word of its own)."""
        b = np.ones(len(self.ids), dtype=bool)
        b[1:] = (self.word[1:] != self.word[:-1]) | (self.word[1:] < 0)
        return b

    def clean(self) -> np.ndarray:
        """True for tokens that begin on a character no other token shares."""
        c = np.ones(len(self.ids), dtype=bool)
        c[1:] = self.at[1:] >= self.end[:-1]
        return c


def _same(a: Part, i: int, b: Part, j: int, shift: int, n: int) -> bool:
    """n tokens from i in a and from j in b: same ids, places (b's are moved by shift) and word borders."""
    if i + n > len(a.ids) or j + n > len(b.ids):
        return False
    ab, bb = a.borders()[i : i + n], b.borders()[j : j + n]
    return bool((a.ids[i : i + n] == b.ids[j : j + n]).all() and (a.at[i : i + n] == b.at[j : j + n] + shift).all() and (ab[1:] == bb[1:]).all())


def concat(tok, left: Part, right: Part, first: int = 64) -> Part:
    """Both parts as one, exactly as if the whole text had been encoded."""
    nl, nr = len(left.text), len(right.text)
    lc, rc = left.clean(), right.clean()
    lb, rb = left.borders(), right.borders()
    reach = first
    while True:
        # The window starts where a token of the left part starts: on a word border if there is one near.
        ok = np.flatnonzero(lc & (left.at <= nl - reach))
        near = ok[lb[ok]][-1:] if len(ok) else ok
        starts = [int(x) for x in (*near[::-1], *ok[-1:])]
        b = min(nr, reach * 2)
        for i in dict.fromkeys(starts):
            a = int(left.at[i])
            w = Part.of(tok, left.text[a:] + right.text[:b])
            if not _same(left, i, w, 0, a, AGREE) or (len(w.at) and w.at[0] != 0):
                continue
            if left.at[i + AGREE - 1] >= nl - reach // 4:
                continue
            wc, wb = w.clean(), w.borders()
            shift = nl - a
            place = {int(p): k for k, p in enumerate(w.at) if wc[k]}
            for j in np.flatnonzero(rc & (right.at > 0) & (right.at < b - reach // 4)):
                k = place.get(int(right.at[j]) + shift)
                if k is None or wb[k] != rb[j] or not _same(right, int(j), w, k, -shift, AGREE) or right.at[j + AGREE - 1] > b - reach // 4:
                    continue
                out = Part(
                    left.text + right.text,
                    np.concatenate([left.ids[:i], w.ids[:k], right.ids[j:]]),
                    np.concatenate([left.at[:i], w.at[:k] + a, right.at[j:] + nl]),
                    np.concatenate([left.end[:i], w.end[:k] + a, right.end[j:] + nl]),
                    np.concatenate([left.word[:i], w.word[:k], right.word[j:]]),
                )
                # Words are numbered anew; the window's first token begins a word only where it did on the left.
                begins = np.concatenate([lb[: i + 1], wb[1:k], rb[j:]])
                out.word = np.where(out.word < 0, -1, np.cumsum(begins))
                return out
        if reach > nl + nr:
            return Part.of(tok, left.text + right.text)
        reach *= 2


def join_tree(tok, parts: list[Part]) -> Part:
    """Concatenate neighbours until one part is left."""
    while len(parts) > 1:
        parts = [concat(tok, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def decode(tok, ids) -> str:
    return tok.decode(list(ids), skip_special_tokens=False)


def _digest(tok, ids) -> tuple[int, str, str]:
    return len(ids), sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), sha256(decode(tok, ids).encode("utf-8", "replace")).hexdigest()


class Pieces:
    """Encodings of the stretches between spaces, for tokenizers that drop white space and join decoded tokens by spaces.

    A text's ids are those of its stretches one after another, and stretches
    recur, so each is encoded once while it is remembered (``most`` of them). A
    stretch may lose commas and stops behind a letter, where a word always
    ends, and one of letters only its capitals; new words are encoded together
    and told apart by their end marks.
    """

    def __init__(self, tok, most: int = 400_000):
        self.tok, self.most, self.known = tok, most, {"": (b"", "")}
        self.placed: dict[str, tuple[bytes, bytes, bytes, bytes, int]] = {}
        self.words = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        self.ends = np.array([w.endswith("</w>") for w in self.words])
        self.lengths = np.array([len(w.removesuffix("</w>")) for w in self.words], np.int64)

    @staticmethod
    def fits(tok) -> bool:
        """Whether the tokenizer is of that kind: by its whole configuration, all but the vocabulary."""
        c = json.loads(tok.to_str())
        plain = all(not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in c["added_tokens"])
        m = c["model"]
        model = m["type"] == "BPE" and m["end_of_word_suffix"] == "</w>" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        return plain and model and (c["normalizer"], c["pre_tokenizer"], c["post_processor"], c["decoder"]) == KIND

    def _put(self, piece: str, ids) -> None:
        self.known[piece] = (np.asarray(ids, "<u4").tobytes(), " ".join([self.words[i] for i in ids]))

    def _encode(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if p.isalpha() and max(p) < "\u0250"]
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) == len(part) and (not len(ids) or to[-1] == len(ids)):
                for p, a, b in zip(part, [0, *to.tolist()], to.tolist()):
                    self._put(p, ids[a:b].tolist())
        rest = [p for p in pieces if p not in self.known]
        for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            self._put(p, e.ids)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        core = {}
        for p in new:
            c = p.rstrip(".,")
            if not c or not c[-1].isalpha() or c[-1] >= "\u0100":
                c = p
            core[p] = (c.lower() if c.isascii() and c.isalpha() else c, p[len(c) :])
        need = {x for pair in core.values() for x in pair if x and x not in self.known}
        self._encode(list(need))
        for p, (c, tail) in core.items():
            if p not in self.known:
                a = self.known[c]
                b = self.known[tail] if tail else (b"", "")
                self.known[p] = (a[0] + b[0], " ".join([x for x in (a[1], b[1]) if x]))

    @staticmethod
    def visible(p: str) -> bool:
        return p.isascii() and p.isprintable() and "<|" not in p

    def _place(self, p: str, x: Part) -> None:
        self.placed[p] = (x.ids.tobytes(), x.at.astype(np.int64).tobytes(), x.end.astype(np.int64).tobytes(), x.word.astype(np.int64).tobytes(), int(x.word.max(initial=-1)) + 1)

    def part(self, text: str) -> Part:
        """A block as ``Part.of`` gives it: the stretches' tokens, their places moved to where the stretch begins and their words numbered on."""
        if len(self.placed) > self.most:
            self.placed = {}
        split = text.replace("\n", " ").replace("\t", " ").split(" ")
        new = {p for p in split if p not in self.placed}
        # Visible ASCII keeps its places: a token is as long as its characters, and a word ends where a token has the end mark.
        plain = [p for p in new if self.visible(p)]
        self.learn(set(plain))
        ids = [self.known[p][0] for p in plain]
        to = np.cumsum([0, *[len(x) // 4 for x in ids]])
        flat = np.frombuffer(b"".join(ids), "<u4")
        size, last = self.lengths[flat], self.ends[flat].astype(np.int64)
        reach, done = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(last)])
        n = np.diff(to)
        ends = reach[1:] - np.repeat(reach[to[:-1]], n)
        begins, word = (ends - size).tobytes(), (done[:-1] - np.repeat(done[to[:-1]], n)).tobytes()
        ends, words = ends.tobytes(), np.diff(done[to]).tolist()
        for p, x, a, b, k in zip(plain, ids, (8 * to[:-1]).tolist(), (8 * to[1:]).tolist(), words):
            self.placed[p] = (x, begins[a:b], ends[a:b], word[a:b], k)
        rest = list(new.difference(plain))
        for p, e in zip(rest, self.tok.encode_batch(rest, add_special_tokens=False)):
            self._place(p, Part.from_encoding(p, e))
        got = [self.placed[p] for p in split]
        n = np.array([len(g[0]) // 4 for g in got])
        starts = np.zeros(len(split), np.int64)
        np.cumsum([len(p) + 1 for p in split[:-1]], out=starts[1:])
        before = np.zeros(len(split), np.int64)
        np.cumsum([g[4] for g in got[:-1]], out=before[1:])
        ids, at, end, word = (np.frombuffer(b"".join([g[i] for g in got]), t) for i, t in enumerate((np.uint32, np.int64, np.int64, np.int64)))
        shift = np.repeat(starts, n)
        return Part(text, ids, at + shift, end + shift, np.where(word < 0, -1, word + np.repeat(before, n)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian bytes, decoded text) of each text."""
        if len(self.known) > self.most:
            self.known = {"": (b"", "")}
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        known, out = self.known, []
        for pieces in split:
            got = [known[p] for p in pieces]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", block: int = BLOCK, with_ids: bool = True, deal: int = DEAL) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): one row for each input row, of its whole text.

    Rows with long texts are told apart first; their blocks are dealt over all
    tasks, and only the joins of one text (as large as that text's own row) meet again.
    """
    kind = dict(docs.dtypes)[id_col]
    t = F.coalesce(F.col(text), F.lit(""))
    fields = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def rows(keys: pa.Array, found: list, tok) -> pa.RecordBatch:
        d = [_digest(tok, x) for x in found]
        cols = [keys, pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.string()), pa.array([x[2] for x in d], pa.string())]
        if with_ids:
            cols.append(pa.array([list(map(int, x)) for x in found], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def trees(tok, t: str, pieces: Pieces | None) -> tuple[bytes, str]:
        of = pieces.part if pieces else lambda x: Part.of(tok, x)
        one = join_tree(tok, [of(t[i : i + block]) for i in range(0, len(t), block)])
        return np.asarray(one.ids, "<u4").tobytes(), decode(tok, one.ids.tolist())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        pieces = Pieces(tok) if Pieces.fits(tok) else None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                texts = s.column(1).to_pylist()
                if pieces is None:
                    whole = iter(tok.encode_batch_fast([x for x in texts if len(x) <= block], add_special_tokens=False))
                    yield rows(s.column(0), [next(whole).ids if len(x) <= block else np.frombuffer(trees(tok, x, None)[0], "<u4").tolist() for x in texts], tok)
                    continue
                got = pieces.encode([x for x in texts if len(x) <= block])
                if len(got) < len(texts):
                    brief_ = iter(got)
                    got = [next(brief_) if len(x) <= block else trees(tok, x, pieces) for x in texts]
                cols = [s.column(0), pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([sha256(x).hexdigest() for x, _ in got]), pa.array([sha256(d.encode("utf-8", "replace")).hexdigest() for _, d in got])]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x, _ in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for b in batches:
            for key, uid, n, part in zip(*(b.column(i).to_pylist() for i in range(4))):
                p = Part.of(tok, part)
                cols = [pa.array([key], b.column(0).type), pa.array([uid]), pa.array([n], pa.int32()), pa.array([part])]
                cols += [pa.array([np.asarray(x, np.int64).tobytes()]) for x in (p.ids, p.at, p.end, p.word)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "uid", "n", "part", "ids", "at", "end", "word"])

    def joined(group: pa.Table) -> pa.Table:
        tok = load(path)
        got = sorted(group.to_pylist(), key=lambda x: x["n"])
        parts = [Part(x["part"], *(np.frombuffer(x[c], np.int64) for c in ("ids", "at", "end", "word"))) for x in got]
        one = join_tree(tok, parts)
        return pa.Table.from_batches([rows(group.column(id_col).combine_chunks().slice(0, 1), [one.ids.tolist()], tok)])

    is_long = F.length(t) > max(deal, block)
    brief = docs.where(~is_long).select(id_col, t.alias("t")).mapInArrow(short, fields)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / block).cast("int")), lambda i: F.struct(i.alias("n"), F.substring(F.col("t"), i * block + 1, F.lit(block)).alias("part")))
    long = docs.where(is_long).select(id_col, F.monotonically_increasing_id().alias("uid"), t.alias("t")).select(id_col, "uid", F.inline(cut))
    dealt = long.repartition("uid", "n").mapInArrow(blocks, f"`{id_col}` {kind}, uid long, n int, part string, ids binary, at binary, end binary, word binary")
    return brief.unionByName(dealt.groupBy("uid").applyInArrow(joined, fields))


def op1_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, tokenizer_path(), with_ids=False)
