"""Quality rules, line first: rules on punctuation, navigation and boilerplate judge each line, failing lines go,
and a document that loses too much of its text is rejected.

A null text counts as empty. An empty document has no words, fails the base rules and is rejected. Each row is judged
alone, with an id or without, so repeated rows get the same verdict; further columns stay as they are, only doc_id and text are read. Texts and lines of any
length are judged whole. No rows give no rows.

The counts are those of the whole text. The text that is returned lacks the failing lines; blank lines stay, and so does null.
"""

from __future__ import annotations

import operator
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loamgrid.llm.common import as_bytes, hash_words, load, windows

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Base rules: fewest words, and largest percentage of words in repeated windows of eight.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Line rules: a line fails with a larger share of symbols among its characters, of bare separators among its words,
#: of capitals among its ASCII letters or of words equal to the word before (both from four words on), with a phrase of BOILERPLATE,
#: or cut off: with an ending of CUT_OFF.
MOST_SYMBOLS, MOST_SEPARATORS, MOST_CAPITALS, MOST_STUTTER = 0.10, 0.25, 0.80, 0.50
#: A document is rejected if failing lines hold more than this share of its words.
MOST_LOST = 0.5
SEPARATORS = frozenset([b"|", b">", b">>", b"-", b"--", b"*", b"/", b"\\", b"+", "»".encode(), "›".encode(), "·".encode(), "•".encode(), "–".encode(), "—".encode()])
BOILERPLATE = tuple(
    p.encode()
    for p in (
        "lorem ipsum", "enable javascript", "javascript is disabled", "javascript is required", "accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
        "click here", "subscribe to", "sign up now", "sign up for", "log in to", "login to", "share this", "share on", "read more", "skip to content", "skip to main content", "back to top",
        "javascript aktivieren", "cookies akzeptieren", "alle cookies", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "jetzt anmelden", "jetzt registrieren", "mehr lesen", "zum inhalt springen", "nach oben",
        "activer javascript", "accepter les cookies", "tous les cookies", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "abonnez-vous", "lire la suite", "aller au contenu", "haut de page",
        "activar javascript", "aceptar cookies", "todas las cookies", "política de privacidad", "condiciones de uso", "haga clic aquí", "suscríbete", "leer más", "saltar al contenido", "volver arriba",
    )
)
CUT_OFF = (b"...", "…".encode(), b"[more]", b"[...]")
UPPER, LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()
CONTINUED = bytes(range(0x80, 0xC0))

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("n_failed_lines", T.LongType()), T.StructField("n_lost_words", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("text", T.StringType())]
)


def line_fails(line: bytes, words: list[bytes], phrases: list[bytes]) -> bool:
    """words: those of the line, at least one; phrases: those of BOILERPLATE that its text has anywhere."""
    n = len(words)
    if len(line) - len(line.translate(None, SYMBOLS)) > MOST_SYMBOLS * sum(map(len, words)):
        return True
    if not SEPARATORS.isdisjoint(words) and sum(w in SEPARATORS for w in words) > MOST_SEPARATORS * n:
        return True
    if n >= 4:
        if len(line) - len(line.translate(None, UPPER)) > MOST_CAPITALS * max(1, len(line) - len(line.translate(None, LETTERS))):
            return True
        if sum(map(operator.eq, words, words[1:])) > MOST_STUTTER * n:
            return True
    if words[-1].endswith(CUT_OFF):
        return True
    return bool(phrases) and any(p in line.lower() for p in phrases)


def judge(text: bytes) -> tuple[int, int, int, int, int, bool, int, int, bool, bytes]:
    """All columns of SCHEMA after doc_id."""
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, SPACES + CONTINUED))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lower = text.lower()
    phrases = [p for p in BOILERPLATE if p in lower]
    seen, dup, failed, lost, left = set(), 0, 0, 0, []
    for line in text.split(b"\n"):
        if own := line.split():
            dup += line in seen
            seen.add(line)
            if line_fails(line, own, phrases):
                failed += 1
                lost += len(own)
                continue
        left.append(line)
    repeated = 0
    if n > WINDOW:
        h = windows(hash_words(text, lower=False), WINDOW)
        order = np.argsort(h)
        same = np.append(h[order[1:]] == h[order[:-1]], False)
        if same.any():
            edge = np.zeros(n + 1, np.int64)
            same[1:] |= same[:-1]
            at = order[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    base_failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, word_chars, n_symbols, dup, repeated, base_failed, failed, lost, not base_failed and lost <= MOST_LOST * n, b"\n".join(left) if failed else text


def _judged(batches):
    for batch in batches:
        rows = [judge(t) if t is not None else (*judge(b"")[:-1], None) for t in as_bytes(batch.column(1))]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
        texts = pa.array(columns.pop(), pa.binary()).cast(pa.string())
        kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), texts], names=SCHEMA.names)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: the counts, the base verdict, whether the document is kept, and its text without the failing lines. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_judged, SCHEMA)


def _kept(batches):
    for batch in batches:
        rows = [judge(t or b"") for t in as_bytes(batch.column("text"))]
        texts = pa.array([x[-1] for x in rows], pa.binary()).cast(pa.string())  # a null text is never kept
        whole = [texts if c == "text" else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(whole, names=batch.schema.names).filter(pa.array([x[-2] for x in rows], pa.bool_()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep, without the failing lines."""
    return docs.mapInArrow(_kept, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(load(spark, sf_dir, "documents"))
