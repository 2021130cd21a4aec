"""A caller's extractor over batches of pages: order, carry, failures and runs that go on."""

from codicil.operators import corpus as C
from codicil.operators import extract as T


def _tables(spark, n_docs=7):
    pages = [(d, p, None if p == 2 else f"{d}.{p} ") for d in range(n_docs) for p in range(1, 3 * d + 1)] + [(None, 1, "nobody's")]
    d = spark.createDataFrame(pages, "doc_id long, page int, text string").repartition(5)
    return d, C.page_batches(spark.createDataFrame([(d, 3 * d) for d in range(n_docs)], "doc_id long, n int"), "n", 4, 1)


def _joined(texts, carry):
    return f"{carry}>{''.join(texts)}", texts[-1].strip()


def _want(n_docs=7):
    found, page = {}, lambda d, p: "" if p == 2 else f"{d}.{p} "
    for d in range(1, n_docs):
        carry, n = None, 3 * d
        for start in range(1, max(n - 1, 1) + 1, 3):
            end = min(start + 3, n)
            body, carry = _joined([page(d, p) for p in range(start, end + 1)], carry)
            found[d, f"pages-{start:04d}-{end:04d}"] = body
    return found


def _bodies(rows):
    return {(r.doc_id, r.key): r.body for r in rows.collect()}


def test_batches_in_order_with_what_the_one_before_left(spark, tmp_path):
    pages, batches = _tables(spark)
    for rounds in (1, 3):
        assert _bodies(T.extract_to(pages, batches, _joined, f"file://{tmp_path}/{rounds}", rounds)) == _want()


def test_a_run_goes_on_where_the_last_one_stopped(spark, tmp_path):
    pages, batches = _tables(spark)
    path, calls = f"file://{tmp_path}/out", str(tmp_path / "calls")

    def failing(texts, carry):
        if "5.7 " in texts or "6.1 " in texts:
            raise OSError("no answer")
        return _joined(texts, carry)

    def counted(texts, carry):
        with open(calls, "a") as f:
            f.write(f"{texts[0]}\n")
        return _joined(texts, carry)

    first = _bodies(T.extract_to(pages, batches, failing, path, attempts=2))
    tried = T.checkpoints(spark, path, T.checkpoint_schema(pages))
    assert sorted((r.doc_id, r.key, r.error) for r in tried.filter("body IS NULL").collect()) == [(5, "pages-0004-0007", "OSError: no answer"), (6, "pages-0001-0004", "OSError: no answer")]
    left = {k: v for k, v in _want().items() if k not in first}
    assert first == {k: v for k, v in _want().items() if k in first} and len(left) == 4 + 6
    assert _bodies(T.extract_to(pages, batches, counted, path)) == _want()
    assert len(open(calls).readlines()) == len(left)  # only what was left
    assert _bodies(T.extract_to(pages, batches, counted, path)) == _want() and len(open(calls).readlines()) == len(left)


def test_attempts_and_missing_pages(spark, tmp_path):
    pages, batches = _tables(spark)
    tries = str(tmp_path / "tries")

    def second_time(texts, carry):
        with open(tries, "a+") as f:
            f.write("x")
            f.seek(0)
            if len(f.read()) % 2:
                raise OSError("busy")
        return _joined(texts, carry)

    one = batches.filter("doc_id = 3")
    none = spark.createDataFrame([], T.checkpoint_schema(pages))
    assert _bodies(T.extract_batches(pages, one, second_time, none)) == {k: v for k, v in _want().items() if k[0] == 3}
    assert {k[1] for k in _bodies(T.extract_batches(pages.filter("page > 4"), one, _joined, none))} == {"pages-0004-0007", "pages-0007-0009"}
    assert T.extract_batches(pages.limit(0), batches, _joined, none).count() == 0
    assert T.extract_batches(pages, batches.limit(0), _joined, none).count() == 0
