import pickle
import random

from scoreforge.llm import decontaminate as D

from .conftest import ODD, SF001


def substring_distance(pattern, text):
    """Least edit distance to a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_matches_the_full_table():
    random.seed(2)
    for _ in range(60):
        p = "".join(random.choice("abcd ") for _ in range(random.choice([1, 5, 63, 64, 65, 130])))
        t = "".join(random.choice("abcde ") for _ in range(random.randint(0, 200)))
        if random.random() < .6:
            t = t[:20] + p[:len(p) // 2] + "x" + p[len(p) // 2:] + t[20:]
        assert D.myers(p, t)[0] == substring_distance(p, t)
    assert D.myers("kitten", "xxsittingyy") == (2, 8)
    assert D.myers("abc", "xabc", anchored=True) == (1, 4)


def test_matcher_finds_exactly_what_brute_force_finds():
    random.seed(3)
    words = ["thing", "er", "onto", "and", "stead", "ly", "blem", "of", "ran", "tion", "hea", "was"]
    line = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, line(random.randint(1, 25))) for i in range(25)]
    texts = []
    for _ in range(60):
        q = list(random.choice(items)[1])
        for _ in range(random.randint(0, len(q) // 6)):
            k = random.randrange(len(q))
            q[k:k + 1] = random.choice(["", "z", "yy"])
        texts.append(line(random.randint(0, 20)) + " " + "".join(q) + " " + line(random.randint(0, 20)))
    matcher = D.Matcher(items, 0.1)
    for text, hits in zip(texts, matcher.find(texts)):
        plain = D.normal(text)
        for i, item in items:
            budget = int(0.1 * len(item))
            want = substring_distance(item, plain)
            found = [h for h in hits if h[0] == i]
            if budget == 0:
                assert bool(found) == (f" {item} " in f" {plain} ")
            else:
                assert bool(found) == (want <= budget)
                assert not found or found[0][1] == want


def test_spans_are_of_the_original_text():
    item = "the quick brown fox jumps over the lazy dog"
    text = "Intro!! THE -- quick\nbrown fox, jumps over (the) lazy dog. End"
    (_, distance, a, b), = D.Matcher([(9, item)], 0.1).find([text])[0]
    assert distance == 0 and text[a:b] == "THE -- quick\nbrown fox, jumps over (the) lazy dog"


def test_odd_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "Plain words in a row"), (None, "no id here"),
                                   (6, "Plain words in a row")], "item_id long, text string")
    rows = D.find_leaks(make_docs(ODD), bench).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in rows), key=str) == sorted(
        [(4, 4), (4, 6), (4, 4), (4, 6), (5, 4), (5, 6), (None, None)], key=str)
    kept = [r["doc_id"] for r in D.clean_documents(make_docs(ODD), bench).collect()]
    assert kept == [1, 2, 3, 6, 7]
    assert D.find_leaks(make_docs([]), bench).count() == 0
    assert D.find_leaks(make_docs(ODD), bench.limit(0)).count() == 0
    assert len(D.benchmark_blocks(bench, block_chars=10)) > 1
    assert sorted(x for b in D.benchmark_blocks(bench, block_chars=10) for x in b if x[0]) == [
        (4, "plain words in a row"), (6, "plain words in a row")]


def test_items_of_the_table_are_found_and_few_else(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    items = [(r["item_id"], D.normal(r["text"])) for r in bench.collect()]
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in D.normal(r["text"])}
    assert exact <= found and len(found) <= len(exact) + 2


class Shared:
    """A broadcast whose list is loaded anew, as a reused worker does."""

    def __init__(self, items):
        self.items = items

    @property
    def value(self):
        return pickle.loads(pickle.dumps(self.items))


def test_a_worker_never_searches_another_blocks_items():
    for k in range(50):
        items = [(k, f"item number {k} of the benchmark")]
        assert D._matcher(Shared(items), D.digest(items), 0.1).patterns[0].item == k
    assert D._matcher(Shared(items), D.digest(items), 0.2).patterns[0].budget > \
        D._matcher(Shared(items), D.digest(items), 0.1).patterns[0].budget


def test_many_blocks_and_two_benchmarks_in_one_session(spark, make_docs):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(8))
    docs = make_docs([(k, f"before {line(k)} after") for k in range(24)])
    for shift in (0, 100):
        bench = spark.createDataFrame([(k + shift, line(k)) for k in range(24)], "item_id long, text string")
        assert len(D.benchmark_blocks(bench, block_chars=200)) > 3
        rows = D.find_leaks(docs, bench, block_chars=200).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(k, k + shift) for k in range(24)]
