"""Lists of texts that share a shingle: who stays in them, and where a pair meets."""

from colweave.llm import simhash as M


def test_texts_of_far_lengths_share_no_list(spark, monkeypatch):
    """A passage in texts of lengths far apart makes no lists; those of near lengths are compared and found as by brute force."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + "".join(f" t{k}w{i}" for i in range(60 * 2**k)) for k in range(6)]
    near = [f"{passage} " + " ".join(f"n{i}" for i in range(60)) + f" end{k}" for k in range(3)]
    rows, kept = list(enumerate(texts + near)), M.saved

    def seen(df, path=None):
        out = kept(df, path)
        if "parts" in df.columns and "c" not in df.columns:
            lists.update(r.d.hex() for r in out.select("d").distinct().collect())
        return out

    lists = set()
    monkeypatch.setattr(M, "saved", seen)
    got = {r.doc_id: (r.component_key, r.digest.hex()) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {**{k: k for k in range(6)}, 6: 6, 7: 6, 8: 6}
    assert not lists & {got[k][1] for k in range(1, 6)}  # 0 is of about the near copies' length


def test_a_pair_meets_in_its_first_list(spark):
    """Texts that share many lists carry the first of them, and how many come before each."""
    rows = [(h, d, 100, 10 * h) for h in range(20) for d in ("a", "b")] + [(99, "b", 100, 5)]
    got = {(r.h, r.d): r for r in M.with_first_lists(spark.createDataFrame(rows, "h int, d string, n int, i int")).collect()}
    assert len(got) == 41
    assert got[0, "a"]["first"] == list(range(8)) and got[0, "b"]["first"] == [0, 99, *range(1, 7)]
    assert [got[h, "a"].before for h in (0, 3, 8, 19)] == [0, 3, 8, 8] and got[99, "b"].before == 1


def test_largest_class_of_a_list(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x"), (2, "b", "x")]
    got = M.with_largest_class(spark.createDataFrame(rows, "h int, d string, c string")).collect()
    assert sorted((r.h, r.d, r.main) for r in got) == [(1, "a", "x"), (1, "b", "x"), (1, "c", "x")]
