import zlib

import numpy as np
import pytest
from conftest_llm import ODD, SF, rows
from tokenizers import Tokenizer

from spanlake.llm import common, queries, records


def brute(docs, path):
    t, start, out = Tokenizer.from_file(path), 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    got = queries.op7_token_records(spark, SF)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute(docs, queries.tokenizer_path("word_bpe_49k.json")))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_rows(spark, odd, name):
    tok, path = queries.tokenizer_path(name), common.new_path(spark, "t")
    docs = odd.union(spark.createDataFrame([(None, "no id", "en", "a", 5, "", 1)], odd.schema))
    manifest = records.write_records(docs, path, records.tokenizer_encode(tok))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], tok)
    got = records.read_records(spark, path, manifest)
    assert rows(got, "start", "n_tokens", "ids_crc32") == sorted(w[1:] for w in want)
    assert sorted(map(str, rows(got, "doc_id", "start"))) == sorted(str(w[:2]) for w in want)
    # by the index, in any order
    found = {}
    for m in manifest.collect():
        index = records.read_index(path, m.shard)
        assert len(index) == m.docs and int(index[:, 2].sum()) == m.ids
        for k in reversed(range(m.docs)):
            doc_id, ids = records.read_record(path, m.shard, k)
            found[m.first_id + int(index[:k, 2].sum())] = (doc_id, zlib.crc32(ids.tobytes()))
    assert found == {w[1]: (w[0], w[3]) for w in want}


def test_no_rows(spark, none):
    path = common.new_path(spark, "t")
    manifest = records.write_records(none, path, records.tokenizer_encode(queries.tokenizer_path("word_bpe_49k.json")))
    assert records.read_records(spark, path, manifest).count() == 0


def test_damage_is_found(tmp_path):
    from pyarrow import fs

    data = records.frame(b"\0" * 9 + b"\5\0\0\0")
    (tmp_path / "a").write_bytes(data * 2)
    assert len(list(records.scan_shard(fs.LocalFileSystem(), str(tmp_path / "a")))) == 2
    (tmp_path / "a").write_bytes(data + data[:-6] + b"\1" + data[-5:])
    with pytest.raises(ValueError):
        list(records.scan_shard(fs.LocalFileSystem(), str(tmp_path / "a")))
    (tmp_path / "a").write_bytes(data + data[:-3])
    with pytest.raises(ValueError):
        list(records.scan_shard(fs.LocalFileSystem(), str(tmp_path / "a")))
