"""Public tokenizers: where their vocabulary files are, and their encodings."""

from __future__ import annotations

import base64
import importlib.util
from pathlib import Path

#: Pre-tokenisation pattern of the byte-level BPE vocabulary used by default (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, else where the public tokenizers are installed."""
    if folder:
        return str(Path(folder, name))
    spec = importlib.util.find_spec("public_tokenizers")
    base = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(base / name)


def load_tokenizer(path: str):
    """The byte-level BPE encoding of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
