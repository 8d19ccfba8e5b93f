"""Language-model scores of documents: subword lattice likelihood under a unigram model of vocabulary pieces.

A word is a mark and its bytes; a lattice has an edge for each place where a piece of an existing vocabulary fits, and
single bytes everywhere, so every text has a segmentation. A word's probability is the sum over all segmentations of
the product of piece probabilities, which forward recursion in log space gives without listing them; a document's is
the product over its words and an end mark. With piece probabilities that add up to one this is a proper distribution.

The vocabulary's own scores weight the segmentations first; each training round then takes the expected use of every
piece over all segmentations of all training words (forward and backward recursion) and adds the vocabulary's weights
to it as a prior. The first round so settles what the scores alone would, later ones sharpen it.

Documents are read once: their words are numbered within blocks of bounded size, the numbers lie as files in the shared
folder, and the distinct words of each block go to one table. Counts, probabilities and the way back to the blocks are
groupings and joins of that table, whose size follows the text. Only the pieces' expected use, one number for each piece
of the vocabulary, reaches the driver.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.llm import storage

#: Bytes of text that one block of documents holds; one longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Bytes of words that one lattice computation holds; one longer word is held alone.
LATTICE_BYTES = 1 << 19
ROUNDS = 3
#: How many tokens' weight the vocabulary's own scores have beside the training text.
PRIOR = 2000.0
#: Stands before a word; no byte of UTF-8 text.
MARK = 0xFF
_LN10 = float(np.log(10))

_VOCABULARIES: dict[str, "Vocabulary"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def prior_weights(scores: np.ndarray) -> np.ndarray:
    """Piece weights from a file's scores: log probabilities, or whole numbers that rank merges (Zipf's law)."""
    if len(scores) and (scores == np.round(scores)).all():
        ranks = np.empty(len(scores))
        ranks[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
        return 1.0 / (2.0 + ranks)
    return np.exp(scores)


class Vocabulary:
    """Pieces as byte strings with prior weights, and a trie of them; ``end`` is the number of the end mark.

    Pieces that hold a capital A-Z fit nowhere, as texts have none; they are left out. Of two pieces with the same bytes
    one stays, with the weight of both. Every byte is a piece; those that the file lacks have the least weight.
    """

    def __init__(self, pieces: list[tuple[bytes, float]]):
        weights: dict[bytes, float] = {}
        for piece, weight in pieces:
            if piece and not any(65 <= b <= 90 for b in piece):
                weights[piece] = weights.get(piece, 0.0) + weight
        least = min(weights.values(), default=1.0)
        for b in range(256):
            weights.setdefault(bytes([b]), least)
        self.pieces = sorted(weights)
        self.end = len(self.pieces)
        self.prior = np.array([*(weights[p] for p in self.pieces), least])
        self.prior /= self.prior.sum()
        used = sorted({b for p in self.pieces for b in p})
        self.classes = np.zeros(256, np.int64)  # 0 fits no piece: what follows a word
        self.classes[used] = np.arange(1, len(used) + 1)
        nodes: list[dict[int, int]] = [{}]
        found = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for b in piece:
                node = nodes[node].setdefault(b, len(nodes))
                if node == len(nodes):
                    nodes.append({})
                    found.append(-1)
            found[node] = number
        self.width = len(used) + 1
        child = np.full((len(nodes), self.width), -1, np.int32)
        for node, onward in enumerate(nodes):
            for b, to in onward.items():
                child[node, self.classes[b]] = to
        self.child, self.piece_at = child.reshape(-1), np.array(found, np.int32)

    @classmethod
    def of_file(cls, path: str) -> "Vocabulary":
        """Of a sentencepiece model file; made once a worker."""
        if path not in _VOCABULARIES:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            numbers = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
            plain = [i for i in numbers if not model.is_byte(i)]
            weights = prior_weights(np.array([model.get_score(i) for i in plain]))
            pieces = [(model.id_to_piece(i).replace("▁", "\udcff").encode("utf-8", "surrogateescape"), w) for i, w in zip(plain, weights.tolist(), strict=True)]
            least = float(weights.min(initial=1.0))
            pieces += [(bytes([int(model.id_to_piece(i)[3:5], 16)]), least) for i in numbers if model.is_byte(i)]
            _VOCABULARIES[path] = cls(pieces)
        return _VOCABULARIES[path]


class Lattice:
    """All edges of the lattices of some words, in one row of cells; each word has a cell for each place and one behind."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64) + 2  # the mark, the bytes, the cell behind
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.last = self.first + sizes - 1
        mark = bytes([MARK])
        raw = np.frombuffer(b"".join([mark + w + b"\0" for w in words]), np.uint8)
        kinds = vocabulary.classes[raw]
        kinds[self.last] = 0
        start, node, depth = np.delete(np.arange(len(raw)), self.last), None, 0
        starts, ends, pieces = [], [], []
        while len(start):
            step = kinds[start + depth]
            node = vocabulary.child[step if node is None else node.astype(np.int64) * vocabulary.width + step]
            fits = node >= 0
            start, node, depth = start[fits], node[fits], depth + 1
            piece = vocabulary.piece_at[node]
            hit = piece >= 0
            starts.append(start[hit])
            ends.append(start[hit] + depth)
            pieces.append(piece[hit])
        self.start, self.to, self.piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, pieces))
        self.cells, self.sizes, self.own = len(raw), sizes, np.repeat(np.arange(len(words)), sizes)

    def _in_order(self, distance: np.ndarray):
        """Edges by their distance, nearest first. Those of one distance lead to different cells."""
        order = np.argsort(distance.astype(np.uint16) if distance.max(initial=0) < 1 << 16 else distance, kind="stable")
        counts = np.bincount(distance)
        at = 0
        for n in counts.tolist():
            if n:
                yield order[at : at + n]
            at += n

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of what leads to each cell."""
        alpha = np.full(self.cells, -np.inf)
        alpha[self.first] = 0.0
        weight = log_p[self.piece]
        for edges in self._in_order(self.start - self.first[self.own[self.start]]):
            to = self.to[edges]
            alpha[to] = np.logaddexp(alpha[to], alpha[self.start[edges]] + weight[edges])
        return alpha

    def totals(self, log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        return self.forward(log_p)[self.last]

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations, words counted ``counts`` times."""
        alpha, beta, weight = self.forward(log_p), np.full(self.cells, -np.inf), log_p[self.piece]
        beta[self.last] = 0.0
        word = self.own[self.start]
        for edges in self._in_order(self.last[word] - self.to):
            start = self.start[edges]
            beta[start] = np.logaddexp(beta[start], weight[edges] + beta[self.to[edges]])
        share = np.exp(alpha[self.start] + weight + beta[self.to] - alpha[self.last][word]) * counts[word]
        return np.bincount(self.piece, weights=share, minlength=len(log_p))


def _portions(words: list[bytes]):
    """Ranges of words that together hold ``LATTICE_BYTES`` at most, unless it is a single word."""
    at, size = 0, 0
    for i, word in enumerate(words):
        if i > at and size + len(word) > LATTICE_BYTES:
            yield slice(at, i)
            at, size = i, 0
        size += len(word) + 2
    if at < len(words):
        yield slice(at, len(words))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8 between ASCII white space, A-Z as small letters; none for a null."""
    return text.lower().split() if text else []


def _number_words(folder: str, kept: int):
    """Number the words of blocks of documents; write each block's numbers as a file, its distinct words as rows."""

    def settle(rows: list, lengths: list[int], numbers: list[np.ndarray], words: dict, train: list[bool]) -> pa.RecordBatch:
        name = uuid.uuid4().int >> 65  # of this attempt alone, so that its rows and its file belong together
        every = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        block = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        cuts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64())
        columns = [*block.columns, pa.LargeListArray.from_arrays(cuts, pa.array(every, pa.int32()))]
        batch = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(kept + 1)])
        storage.write_part(f"{folder}/{name:016x}", [batch], batch.schema)
        use = np.repeat(np.array(train), lengths)
        n = np.bincount(every[use], minlength=len(words))
        count = len(words) + 1  # the end mark is a null word
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(count, name)),
                pa.array(np.arange(-1, len(words), dtype=np.int32)),
                pa.array([None, *words], pa.binary()),
                pa.array(np.concatenate([[sum(train)], n]), pa.int64()),
            ],
            names=["block", "number", "word", "n"],
        )

    def run(batches):
        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            return [], [], [], words, []

        rows, lengths, numbers, words, train = fresh()
        size = 0
        for batch in batches:
            at = 0
            for i, (text, use) in enumerate(zip(batch.column(kept), batch.column(kept + 1).to_pylist(), strict=True)):
                raw = text.as_py()
                own = tokens_of(raw)
                numbers.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                lengths.append(len(own))
                train.append(use)
                size += len(raw or b"")
                if size >= BLOCK_BYTES:
                    rows.append(batch.slice(at, i + 1 - at).select(range(kept)))
                    at, size = i + 1, 0
                    yield settle(rows, lengths, numbers, words, train)
                    rows, lengths, numbers, words, train = fresh()
            if at < len(batch):
                rows.append(batch.slice(at).select(range(kept)))
        if rows:
            yield settle(rows, lengths, numbers, words, train)

    return run


def _expected_use(path: str, log_p: np.ndarray):
    def run(batches):
        vocabulary, total = Vocabulary.of_file(path), np.zeros(len(log_p))
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for part in _portions(words):
                total += Lattice(vocabulary, words[part]).expected(log_p, counts[part])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "use"])

    return run


def _word_scores(path: str, log_p: np.ndarray):
    def run(batches):
        vocabulary = Vocabulary.of_file(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            scores = [Lattice(vocabulary, words[part]).totals(log_p) / _LN10 for part in _portions(words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.empty(0)]))], names=["word", "c", "score"])

    return run


def _document_scores(folder: str, kept: int, n: int, v: int, ends: int, end_score: float):
    """Take a block's words' counts and scores to its documents."""

    def run(key, rows):
        block = next(iter(storage.read_part(f"{folder}/{key[0].as_py():016x}")))
        number, counts, scores = (rows.column(i).to_numpy() for i in (1, 2, 3))
        base, known, own = np.empty(len(number)), np.empty(len(number)), np.empty(len(number))
        base[number] = np.log10((counts + 1) / (n + v + 1))
        known[number], own[number] = counts > 0, scores
        words = block.column(kept)
        cuts = words.offsets.to_numpy()
        every = words.values.to_numpy()[cuts[0] : cuts[-1]]
        lengths = np.diff(cuts)
        doc = np.repeat(np.arange(len(block)), lengths)

        def summed(values: np.ndarray, end: float) -> np.ndarray:
            return np.bincount(doc, weights=values[every], minlength=len(block)) + end

        found = [lengths + 1, summed(known, ends > 0).astype(np.int64), np.full(len(block), n), summed(base, np.log10((ends + 1) / (n + v + 1))), summed(own, end_score)]
        return pa.Table.from_arrays([*block.columns[:kept], *map(pa.array, found)], names=[f"c{i}" for i in range(kept + len(found))])

    return run


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_documents(
    docs: DataFrame,
    train: Column,
    work: storage.Workspace,
    keep: tuple[str, ...] = ("doc_id",),
    path: str | None = None,
    rounds: int = ROUNDS,
    prior: float = PRIOR,
    text_col: str = "text",
) -> DataFrame:
    """The columns in ``keep`` plus ``n_tokens, n_known, train_tokens, base_score, score``, one row for each row.

    Tokens are the words of a text, A-Z as small letters, and one end; a null or empty text is an end alone. ``train``
    says which rows are learned from (null: not). ``n_known`` counts tokens that occur in training, ``train_tokens`` all
    training tokens. ``base_score`` adds log10((c + 1) / (N + V + 1)) over tokens: c a token's training count, N all,
    V distinct ones. ``score`` is log10 of the text's probability in the lattice model, whose pieces are those of the
    sentencepiece file at ``path`` (on every worker). Without training rows the vocabulary's own weights remain. Long
    texts and words are whole. Repeated rows each count and each come out; sums may differ in the last digits between
    layouts. An empty table gives no rows. Other columns are ignored; one to keep that is named like a result is refused.
    """
    path, own = path or default_path(), list(keep)
    if clash := {c.lower() for c in own} & set(RESULTS):
        raise ValueError(f"columns to keep are named like results: {sorted(clash)}")
    fields, kept = docs.select(*own).schema.fields, len(own)
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], F.col(text_col).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    folder = f"{work.path}/numbers"
    words = work.table(plain.mapInArrow(_number_words(folder, kept), "block long, number int, word binary, n long"), "words")
    counts = work.table(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("word").isNull(), F.col("c")))).collect()[0]
    n, v, ends = (int(x or 0) for x in total)

    vocabulary = Vocabulary.of_file(path)
    p = vocabulary.prior
    seen = counts.where("word IS NOT NULL AND c > 0").select("word", "c")
    for _ in range(rounds if n else 0):
        use = np.zeros(len(p))
        found = seen.mapInArrow(_expected_use(path, np.log(p)), "piece int, use double").groupBy("piece").agg(F.sum("use").alias("use"))
        for row in found.collect():  # a row for each piece of the vocabulary, at most
            use[row["piece"]] = row["use"]
        use[vocabulary.end] = ends
        p = use + prior * vocabulary.prior
        p /= p.sum()
    log_p = np.log(p)
    scores = work.table(counts.where("word IS NOT NULL").select("word", "c").mapInArrow(_word_scores(path, log_p), "word binary, c long, score double"), "scores")
    back = words.where("word IS NOT NULL").join(scores, "word").select("block", "number", "c", "score")
    none = words.where("word IS NULL").select("block").distinct()  # blocks without any word have documents too
    back = back.unionByName(none.select("block", F.lit(-1).alias("number"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("score")))
    types = [*(f.dataType for f in fields), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    shape = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    done = back.groupBy("block").applyInArrow(_document_scores(folder, kept, n, v, ends, float(log_p[vocabulary.end]) / _LN10), shape)
    done = work.table(done.toDF(*own, *RESULTS), "done")
    for name in ("numbers", "words", "counts", "scores"):
        work.drop(name)
    return done


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    done = score_documents(docs, ~F.col("held_out"), storage.Workspace(spark, "lm"), keep=("doc_id", "held_out"))
    return done.select("doc_id", "held_out", *RESULTS)
