"""SentencePiece encoding and decoding with the tokenizers library: the model's protobuf is parsed and rebuilt there."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, parts, public_id, slim

MARK = "▁"
UNIGRAM, BPE = 1, 2
NEVER = -1e7
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _parse(model: bytes):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


def _merges(pieces) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; of one score, in the order of the parts' ids."""
    ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
    found = []
    for text in ids:
        for cut in range(1, len(text)):
            a, b = ids.get(text[:cut]), ids.get(text[cut:])
            if a is not None and b is not None:
                found.append((-pieces[ids[text]].score, a, b, text[:cut], text[cut:]))
    found.sort(key=lambda x: x[:3])
    return [x[3:] for x in found]


def rebuild(model: bytes):
    """A tokenizers.Tokenizer that encodes and decodes as the SentencePiece model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = _parse(model)
    trained, norm, pieces = proto.trainer_spec, proto.normalizer_spec, proto.pieces
    if trained.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {trained.model_type} is neither unigram nor BPE")
    if any(p.type == USER for p in pieces):
        raise ValueError("user-defined symbols aren't supported")
    if trained.treat_whitespace_as_suffix or not norm.escape_whitespaces:
        raise ValueError("only models that mark white space before a word are supported")
    unk = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if trained.model_type == UNIGRAM:
        # text never matches bytes and control symbols: they may not win against any other way
        scores = [(p.piece, p.score if p.type == NORMAL else NEVER) for p in pieces]
        t = Tokenizer(models.Unigram(scores, unk_id=unk, byte_fallback=trained.byte_fallback))
    else:
        vocab = {p.piece: i for i, p in enumerate(pieces)}
        t = Tokenizer(models.BPE(vocab, _merges(pieces), unk_token=pieces[unk].piece, fuse_unk=True, byte_fallback=trained.byte_fallback))
    steps: list = []
    if norm.precompiled_charsmap:
        # the backend maps a line's end as one sign, the library as two
        steps += [normalizers.Replace("\r\n", "\n\n"), normalizers.Precompiled(norm.precompiled_charsmap)]
    if norm.remove_extra_whitespaces:  # spaces alone, and marks at the end
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("\\A +"), ""), normalizers.Replace(Regex(f"[ {MARK}]+\\z"), "")]
    steps.append(normalizers.Replace(" ", MARK))
    if norm.add_dummy_prefix:
        steps.insert(-1, normalizers.Prepend(" "))
    t.normalizer = normalizers.Sequence(steps)
    inside = [p.piece for p in pieces if p.type == NORMAL and MARK in p.piece.lstrip(MARK)]
    if not inside:  # no piece goes on past a word's end, so words can be encoded one by one, and kept
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else [])])
    return t


class Codec:
    """Encodes texts with the rebuilt tokenizer, and checks each result against the SentencePiece library.

    Where no piece crosses a word's start, a text's ids are its words' ids one after another. Each distinct word is then
    encoded (in multithreaded batches), compared and decoded once, and its ids kept; a full store is emptied. One text in WHOLE is
    also encoded by both as it is, and compared.
    """

    LINE = 256  # words encoded as one text
    LINES = 64  # texts encoded at once
    STORE = 250_000  # words kept
    WHOLE = 32  # one text in so many, by a checksum, is encoded as a whole too

    def __init__(self, model: bytes, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.threads = threads
        self.own = rebuild(model)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.own.get_vocab_size()
        self.starts = np.array([(self.own.id_to_token(i) or "").startswith(MARK) for i in range(size)])
        proto = _parse(model)
        norm = proto.normalizer_spec
        self.space = self.own.token_to_id(MARK)
        # sums of a unigram model's scores run over the whole text in the library, so there equally good ways are told apart by what precedes
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        self.by_word = proto.trainer_spec.model_type == BPE and self.space is not None and self.own.pre_tokenizer is not None and plain
        self.store: dict[str, bytes] = {}
        #: words and texts whose ids differ from the library's, or that don't decode to themselves
        self.odd: set[str] = set()
        self.lossy: set[str] = set()

    def forget(self) -> None:
        for kept in (self.store, self.odd, self.lossy):
            kept.clear()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _judge(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each compared and decoded."""
        got = self._encode(texts)
        want = self.theirs.encode(texts, num_threads=self.threads)
        back = self.own.decode_batch(got, skip_special_tokens=False)
        self.odd.update(t for t, a, b in zip(texts, got, want, strict=True) if a != b)
        self.lossy.update(t for t, a in zip(texts, back, strict=True) if a != t)
        return [np.array(x, np.int32).tobytes() for x in got]

    def _learn(self, words: set[str]) -> None:
        plain = [w for w in words if w and w[0] != " " and MARK not in w]
        rest = [w for w in words if w and (w[0] == " " or MARK in w)]
        every = [plain[i : i + self.LINE] for i in range(0, len(plain), self.LINE)]
        for k in range(0, len(every), self.LINES):
            lines = every[k : k + self.LINES]
            texts = [" ".join(x) for x in lines]
            got = self._encode(texts)
            want = self.theirs.encode(texts, num_threads=self.threads)
            back = self.own.decode_batch(got, skip_special_tokens=False)
            for line, text, a, b, again in zip(lines, texts, got, want, back, strict=True):
                ids = np.array(a, np.int32)
                at = np.flatnonzero(self.starts[ids])
                if a != b or again != text or len(at) != len(line):
                    rest += line  # one by one, to see which
                    continue
                packed, edge = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
                self.store.update(zip(line, (packed[i:j] for i, j in zip(edge, edge[1:], strict=False)), strict=True))
        for k in range(0, len(rest), self.LINE * self.LINES):
            some = rest[k : k + self.LINE * self.LINES]
            self.store.update(zip(some, self._judge(some), strict=True))

    @staticmethod
    def _words(text: str) -> list[str]:
        """What follows each single space of ' ' + text; where spaces repeat, the further ones go with the word after."""
        words = text.split(" ")
        if "" in words and text:
            out, run = [], 0
            for w in words[:-1]:
                if w:
                    out.append(" " * run + w)
                    run = 0
                else:
                    run += 1
            return [*out, " " * run + words[-1]]
        return words if text else []

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """For each text: ids as little-endian 32-bit integers, whether the library agrees, whether decoding gives the text."""
        if not self.by_word:
            ids = self._judge(texts)
            out = ids, [t not in self.odd for t in texts], [t not in self.lossy for t in texts]
            self.odd.clear()
            self.lossy.clear()
            return out
        split = [self._words(t) for t in texts]
        new = set().union(*split).difference(self.store)
        if len(self.store) + len(new) > self.STORE:
            self.forget()
            new = set().union(*split)
        self._learn(new)
        get = self.store.__getitem__
        self.store[""] = np.array([self.space], np.int32).tobytes()  # a text's last space
        ids = [b"".join(map(get, w)) for w in split]
        same, back = [self.odd.isdisjoint(w) for w in split] if self.odd else [True] * len(split), [self.lossy.isdisjoint(w) for w in split] if self.lossy else [True] * len(split)
        whole = [k for k, t in enumerate(texts) if zlib.crc32(t.encode()) % self.WHOLE == 0]
        if whole:
            some = [texts[k] for k in whole]
            for k, a, b in zip(whole, self._encode(some), self.theirs.encode(some, num_threads=self.threads), strict=True):
                same[k] = np.array(a, np.int32).tobytes() == np.array(b, np.int32).tobytes() == ids[k]
        return ids, same, back


@functools.lru_cache(maxsize=2)
def _codec(model: bytes, threads: int) -> Codec:
    return Codec(model, threads)


ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, parity boolean, round_trip boolean"


def _encoder(model, threads: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        codec = _codec(model.value, threads)
        for whole in batches:
            for batch in parts(whole, most=500_000):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                ids, same, back = codec.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                cols = [*kept, pa.array(np.diff(ends), pa.int64()), tokens, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_tokens", "ids", "ids_sha256", "parity", "round_trip"])
        codec.forget()  # the worker may do other things next

    return run


def encode(docs: DataFrame, model: str | None = None, threads: int = 2) -> DataFrame:
    """Token ids of every whole text, by a SentencePiece model file rebuilt in the tokenizers library.

    Returns for each row doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian 32-bit integers), parity (the
    sentencepiece library gives the same ids, for the text's words, or the whole text where Codec says so; two equally good ways
    through a unigram model may differ) and round_trip (decoding the ids gives the text; false for texts that hold the
    white-space marker itself). A null text is empty; an empty text has no tokens. A null doc_id stays null. Repeated rows are
    encoded alike. Very long texts are encoded whole; all other columns are left out, whatever their names. An empty table gives no
    rows. ``model``: path on the driver; the file is broadcast (a vocabulary, whose size
    doesn't follow the input).
    """
    with open(model or default_model(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    out = slim(docs).mapInArrow(frugal(_encoder(sent, threads, ["doc_id"])), ENCODED)
    return out.withColumn("doc_id", public_id())


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    with open(model or default_model(), "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, 2)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = batch.column(1).to_pylist()
                texts = codec.own.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if x is not None else None for t, x in zip(texts, ids, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
