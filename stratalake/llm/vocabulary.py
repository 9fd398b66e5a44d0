"""Where public vocabulary files are: a parameter, looked up in the installed collection unless given."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
