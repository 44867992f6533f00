"""The pieces of a public subword vocabulary (a sentencepiece model file; its path is a parameter)."""

from __future__ import annotations

import os
from functools import lru_cache

PIECES = os.environ.get("CITEMESH_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Stands for the space before a word in the vocabulary file.
MARK = "▁"


@lru_cache(maxsize=4)
def load_pieces(path: str = PIECES) -> tuple[str, ...]:
    """Ordinary pieces by id; control, unknown and byte pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
