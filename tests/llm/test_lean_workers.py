import subprocess
import sys
from pathlib import Path

import pytest

PROGRAM = """
import re
import random
import pyarrow as pa
from panelspark.llm import lines, quality
from panelspark.llm.common import lean

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    random.seed(1)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    for k in range(6):
        texts = ["\\n".join(" ".join(random.choice(words) for _ in range(30)) for _ in range(10)) for _ in range(1000)]
        ids = pa.array(range(1000))
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "key", "text"])

for _ in lean(lambda rows: rows)(batches()):
    pass
before = held()
for _ in lean(lines._sign(1))(batches()):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read")
def test_a_worker_gives_back_what_signing_lines_took():
    root = Path(__file__).parent.parent.parent
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, capture_output=True, text=True, check=True)
    assert float(done.stdout.split()[-1]) < 30


def test_packing_keeps_no_words_where_it_is_told_to():
    import pyarrow as pa
    from public_tokenizers import path

    from panelspark.llm.packing import _pieces
    from panelspark.llm.wordpieces import word_pieces

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three", None])], ["doc_id", "text"])
    kept = list(_pieces(path("word_bpe_49k.json"), 1, 4096)(iter([batch])))
    assert len(word_pieces(path("word_bpe_49k.json")).kept) > 1
    assert list(_pieces(path("word_bpe_49k.json"), 1, 4096, forget=True)(iter([batch]))) == kept
    assert len(word_pieces(path("word_bpe_49k.json")).kept) == 1
