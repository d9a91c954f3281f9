"""A text with the space mark changes no other text's ids."""

import pyarrow as pa
import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import queries  # noqa: E402


@pytest.mark.parametrize("mark", ["a▁", "▁", "▁a", "a▁▁", "▁▁▁"])
@pytest.mark.parametrize("other", ["日本", "\x85sñ½", "ab"])
def test_a_mark_changes_no_other_text(mark, other):
    encoder = queries.piece_model().load()
    encoder._memory.clear()
    encoder._memory[""] = b""
    for texts in ([f"{mark} {other}", f"{other} {mark}", f"{other} x"], [other, f"x {other}"]):
        ids, offsets = encoder.encode_all(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.whole(x).tolist()
