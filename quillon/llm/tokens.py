"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The folder of the vocabulary files, and the file used where none is named.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    """A function from texts to token counts; one per worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores already run one task each
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tool = Tokenizer.from_file(path)
            tool.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(e) for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            tool = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(e) for e in tool.encode(texts, num_threads=1)]
        else:
            import base64

            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            tool = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(tool.encode_ordinary(t)) for t in texts]
    return _LOADED[path]


def _counting(path: str, text: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            sizes: list[int] = []
            chunk: list[str] = []
            held = 0
            for t in texts:  # bounded chunks: encodings are larger than their texts
                chunk.append(t or "")
                held += len(t or "")
                if held > 1_000_000 or len(chunk) >= 256:
                    sizes += _encoder(path)(chunk)
                    chunk, held = [], 0
            if chunk:
                sizes += _encoder(path)(chunk)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    return run


def sized(documents: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Replace the text by ``tokens``, its number of tokens; null and empty texts have none. Whole texts are encoded."""
    path = vocabulary or f"{FOLDER}/{VOCABULARY}"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != text)
    return documents.mapInArrow(_counting(path, text), f"{ddl}, tokens long")
