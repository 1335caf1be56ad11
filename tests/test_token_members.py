"""M3: every file of a class of renamed copies is listed with its representative."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_members_cover_the_classes_of_the_pairs(spark):
    q = entry.queries()
    members = q["m3_token_members"](spark, SF)
    sizes = {r.first_path: r["count"] for r in members.groupBy("language", "first_path").count().collect()}
    pairs = q["m3_token_similarity"](spark, SF).where("path_a = path_b").collect()
    assert pairs and all(sizes[r.path_a] == r.n_files_a for r in pairs)
    assert {r.path_a for r in pairs} == {p for p, n in sizes.items() if n > 1}
