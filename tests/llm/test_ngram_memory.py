"""What a map task of the n-gram join holds at once."""
import tracemalloc

import pyarrow as pa

from tillroll.llm import op3_ngram_join as J


def test_map_task_holds_few_postings():
    texts = [" ".join(f"w{i * 7919 % 9973}x{j}" for j in range(300)) for i in range(9000)]
    batches = [pa.record_batch({"doc_id": pa.array(range(lo, lo + 1000), pa.int64()), "text": texts[lo:lo + 1000]}) for lo in range(0, len(texts), 1000)]
    tracemalloc.start()
    try:
        found = sum(batch.num_rows for batch in J._map(5, 80, 48, J.FREQUENT)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 0
    assert peak < 90e6, peak
