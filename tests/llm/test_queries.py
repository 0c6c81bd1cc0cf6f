"""The thin queries on the smallest tables: the contract's columns, types and rows, and what SQL or plain code can say of them."""

import os
import zlib

import duckdb
import pytest

from scorefold.llm import common, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CONTRACT = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_decontaminate": "doc_id bigint, contaminated boolean",
    "op10_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op12_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


def shown(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for part in CONTRACT[name].split(", "):
        column, kind = part.split()
        assert kinds[column] == kind, part
    rows = df.collect()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    docs = sorted(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())
    if "doc_id" in kinds and name not in ("op1_best_fit_packing", "op12_ranked_search"):
        assert sorted(r.doc_id for r in rows) == docs
    if "held_out" in kinds:
        mod, rest = (10, 0) if name.startswith("op10") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    if "predicted" in kinds:
        least = 0.7 if name.startswith("op4") else 0.5
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)
    if name.startswith("op1_"):
        assert sorted({r.doc_id for r in rows}) == docs and max(r.length for r in rows) <= queries.ROOM
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            ends = [0]
            for offset, n in sorted(own):
                assert offset == ends[-1]
                ends.append(offset + n)
            assert ends[-1] <= queries.ROOM
    if name.startswith("op3_"):
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert r.start == start
            start += r.n_tokens
    if name.startswith("op10"):
        texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
        assert all(r.n_tokens == len(common.words(texts[r.doc_id])) + 1 for r in rows)
        assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
    if sql := queries.oracle_sql().get(name):
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns) and shown(tuple(r[n] for n in names) for r in rows) == shown(want.fetchall())
