"""The URL trees: what they look at, urls that another generator makes, and odd tables."""

import random

from leafspark.llm import url_filter as U


def used(tree):
    return set() if len(tree) == 1 else {U.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def other_urls(n=400):
    rng = random.Random(8)
    nouns = "lamp valley orchard bakery harbor sparrow lantern meadow quartz willow cabin ferry".split()
    out = []
    for k in range(n):
        host, tld = rng.choice(nouns) + rng.choice(["", "", rng.choice(nouns), f"-{rng.choice(nouns)}"]), rng.choice(["com", "org", "net", "de"])
        out.append((f"https://{rng.choice(['', 'www.'])}{host}.{tld}/{rng.choice(['about', 'shop/item/12', '2021/04/' + '-'.join(rng.sample(nouns, 3)), f'{rng.choice(nouns)}.html', f'page/{k}'])}", 0))
        letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(12, 20)))
        params = "&".join(f"{rng.choice('abcdxyz')}{i}={rng.randint(1, 10**8)}" for i in range(rng.randint(3, 7)))
        out.append((rng.choice([f"http://{letters}.{rng.choice(['xyz', 'top', 'info'])}/{rng.randint(1, 10**6)}?{params}", f"http://login-{letters}-secure-{rng.choice(nouns)}.com/x?{params}", f"http://{letters}.click/{'/'.join(str(rng.randint(1, 10**6)) for _ in range(6))}?{params}"]), 1))
    return out


def test_trees_use_many_features():
    names = set().union(*map(used, U.default_model().trees))
    assert len(names & {"length", "depth", "digit ratio", "host digit ratio", "entropy", "host entropy", "parameters", "suffix rate", "suffix count"}) >= 5


def test_urls_of_another_generator():
    urls = other_urls()
    found = U.default_model().block_probability([u for u, _ in urls]) > 0.5
    assert sum(f == bool(y) for f, (_, y) in zip(found, urls)) / len(urls) > 0.9


def test_words_alone_do_not_decide():
    p = U.default_model().block_probability(["http://fast-food.example.org/", "https://weight-watch.net/", "http://casinoslotsbonus.example.com/", "http://zzqx19-login-verify.xyz/?a=1&b=2&c=3"])
    assert list(p > 0.5) == [False, False, True, True]


def test_odd_tables(spark):
    schema = "page_id long, url string, host string, rule string, score string, _r string"
    rows = [(1, "http://a.com/en/1" + "/x" * 20_000, "", "", "", ""), (2, None, "", "", "", ""), (2, None, "", "", "", ""), (None, "none", "", "", "", "")]
    got = sorted((r.page_id or -1, r.host, len(r.path), r.rule or "") for r in U.judge_urls(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, "", 0, ""), (1, "a.com", 40_005, "com/en/"), (2, "", 0, ""), (2, "", 0, "")]
    assert U.judge_urls(spark.createDataFrame([], schema)).count() == 0
