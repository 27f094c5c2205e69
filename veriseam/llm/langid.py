"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; a binary classifier over hashed byte n-grams (2 and 3 bytes) predicts each
bit. A text is decoded to the language whose codeword loses least: the losses exp(-margin * bit) of the bits are added,
weighted by how reliable the bit was in training. The score is the softmax share of the winner, and a text is flagged
ambiguous where the runner-up is close.

The classifiers are ridge regressions fitted on at most PER_LANGUAGE documents of each language (see ``sampling``),
solved over the examples or over the features, whichever are fewer; both give the same weights. Everything is
predicted for whole texts. Null texts and texts without a letter are ``und`` with score 0; so are all texts if there
is nothing to learn from. With one learned language all others are that.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .sampling import held_out, labelled_sample

PER_LANGUAGE = 256
DIMENSIONS = 8192
#: Rows of features held at a time beyond the smaller system of equations.
ROWS = 1024
#: Training pieces of a document besides the whole of it, and their length in bytes.
PIECES, PIECE = 2, 160
RIDGE = 0.3
AMBIGUOUS = 0.1
_LETTER = re.compile(r"[^\W\d_]")


def features(data: bytes) -> np.ndarray:
    """Square roots of the counts of hashed byte 2- and 3-grams, with unit length."""
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503)
    counts = np.bincount(two >> np.uint32(19), minlength=DIMENSIONS)
    if len(b) > 2:
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
        three ^= three >> np.uint32(13)
        counts = counts + np.bincount((three * np.uint32(668265263)) >> np.uint32(19), minlength=DIMENSIONS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(np.linalg.norm(x), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, far from each other; every column has both signs."""
    bits = max(7, 4 * int(np.ceil(np.log2(max(n, 2)))) + 3)
    if n < 2:
        return np.ones((n, bits), dtype=np.int64)
    rng = np.random.default_rng(11)
    best, most = None, (-1, 0)
    for _ in range(400 if n <= 32 else 40):
        code = rng.choice([-1, 1], size=(n, bits))
        flat = np.abs(code.sum(axis=0)) == n
        code[0, flat] *= -1
        apart = (bits - code @ code.T) // 2
        gap = int(apart[~np.eye(n, dtype=bool)].min())
        even = -int(np.abs(code.sum(axis=0)).sum())
        if (gap, even) > most:
            best, most = code, (gap, even)
    return best


class Model:
    def __init__(self, sample: list[tuple]):
        self.languages = sorted({s[0] for s in sample})
        self.code = codewords(len(self.languages)).astype(np.float32)
        rng = np.random.default_rng(5)
        pieces, of = [], []
        for row in sample:
            data = row[1].lower().encode("utf-8", "surrogatepass")
            cuts = [data] + [data[a : a + PIECE] for a in rng.integers(0, max(1, len(data) - PIECE), PIECES)]
            pieces += (d for d in cuts if d.strip())
            of += [self.languages.index(row[0])] * sum(1 for d in cuts if d.strip())
        if not pieces:
            self.languages = []
            return
        y = self.code[of]
        weight = 1 / np.sqrt(np.bincount(of, minlength=len(self.languages))[of]).astype(np.float32)
        weight /= weight.mean()
        blocks = lambda: ((slice(at, at + ROWS), np.array([features(d) for d in pieces[at : at + ROWS]])) for at in range(0, len(pieces), ROWS))
        if len(pieces) <= DIMENSIONS:
            x = np.concatenate([b for _, b in blocks()])
            a = np.linalg.solve(x @ x.T + RIDGE * np.diag(weight), y)
            self.w = (x.T @ a).astype(np.float32)
        else:  # the same weights from the normal equations, with a block of rows in memory
            gram, right = RIDGE * np.eye(DIMENSIONS, dtype=np.float32), np.zeros((DIMENSIONS, y.shape[1]), dtype=np.float32)
            for at, x in blocks():
                scaled = x.T / weight[at]
                gram += scaled @ x
                right += scaled @ y[at]
            self.w = np.linalg.solve(gram, right).astype(np.float32)
        margin = np.concatenate([x @ self.w for _, x in blocks()]) * y
        self.reliable = np.clip((margin > 0).mean(axis=0) - 0.5, 0.01, None) / np.clip(margin.std(axis=0), 0.1, None)
        self.reliable = (self.reliable / self.reliable.sum()).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = features(text.lower().encode("utf-8", "surrogatepass")) @ self.w
        loss = (np.exp(-2 * np.clip(margins * self.code, -3, 3)) * self.reliable).sum(axis=1)
        share = np.exp(-4 * (loss - loss.min()))
        share /= share.sum()
        best = int(share.argmax())
        return self.languages[best], float(share[best]), bool(np.sort(share)[-2] > share[best] - AMBIGUOUS)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(``id_col``, held_out, lang_pred, score, ambiguous) for every row."""
    model = Model(labelled_sample(docs, docs, label=lang_col, per_label=PER_LANGUAGE, id_col=id_col, text_col=text_col))

    def start():
        def step(keys, out, texts):
            made = [model.predict(t) for t in texts]
            return [keys, out, *([m[i] for m in made] for i in range(3))]

        return step

    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), text_col)
    return map_rows(rows, [id_col, "held_out", text_col], start, schema, f"`{id_col}` long, held_out boolean, lang_pred string, score double, ambiguous boolean")
