import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from repoweave.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = Counter()
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        first = True
        for r in sorted(members, key=lambda r: r is not best):
            kept, first = first, False
            out[(r["doc_id"], best["doc_id"], len(members), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def rows_of(decided):
    return Counter(tuple(r) for r in decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_groups(corpora):
    for df, rows in corpora:
        assert rows_of(exact_dedup.find_duplicates(df)[1]) == brute(rows)


def test_texts_are_compared_and_not_only_digests(corpora):
    for df, rows in corpora:
        weak = exact_dedup.find_duplicates(df, digest=lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2)))[1]
        assert rows_of(weak) == brute(rows)


def test_no_rows(empty):
    assert exact_dedup.find_duplicates(empty)[1].collect() == []
    assert exact_dedup.drop_duplicates(empty).collect() == []


def test_kept_rows_are_whole(odd):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == exact_dedup.find_duplicates(odd)[1].where("kept").count()
    assert kept.where("doc_id = 100").count() == 1
