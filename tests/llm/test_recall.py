"""Cases of problems 1, 3 and 5 that do not depend on the size of the table."""

from skein.llm import pairs, repeated_lines, residue

PAGES = "page_id bigint, chunk string, url string"
BODY = "The crust of Velor 123 is 45 km thick, and its dust ring was seen in 2101 by two teams at once."


def test_messages_and_slots_that_recur_on_a_site(spark):
    url = "https://s.example/a/velor-123-{}".format
    rows = [(i, f"# Velor 123\n404 Not Found\nNote {i}", url(i)) for i in range(10)]
    rows += [(i, f"{BODY.replace('45', str(i))}\nPlease enable cookies to comment", url(i)) for i in range(10, 40)]
    rows += [(i, f"Short note {i}\nPlease enable cookies to comment", url(i)) for i in range(40, 45)]
    rows += [(i, f"{BODY} {i}\nObserved by {{{{ name }}}} near it.", url(i)) for i in range(45, 55)]
    got = {r[0]: r[1] for r in residue.residue_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: "error" for i in range(10)} | {i: "slot" for i in range(45, 55)}


def test_long_slots_and_pages_without_url(spark):
    other = "The crust of Other 77 is 45 km thick, and its dust ring was seen in 2101 by two teams at once."
    rows = [
        (1, f"{BODY}\n{{{{ {'name ' * 60}}}}}", "https://s.example/a/velor-123-1"),
        (2, f"Home > News > Velor 123\nAccess denied\nYou may also like\n{other}", None),
        (3, f"Home > News > Velor 123\nAccess denied\n{BODY}", None),
        (4, f"{BODY}\n{'{{ ' * 20000}", None),
    ]
    got = {r[0]: r[1] for r in residue.residue_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "slot", 2: "error"}


def test_sequences_grow_until_none_is_frequent(spark):
    rows = [(i, "\n".join(f"line {chr(97 + k)}" for k in range(9)) + f"\nown {i}", f"https://s.example/{i}") for i in range(8)]
    lengths = [r["length"] for r in repeated_lines.frequent_sequences(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(lengths) == sorted(n for n in range(1, 10) for _ in range(10 - n))


def test_single_refusals(spark):
    rows = [
        (1, "What is the mass of Velor 123?", "As a language model, I am not able to give an answer on Velor 123.", "The mass of Velor 123 is 45 kg."),
        (2, "Who mapped the ridges of Other 9?", "Thank you for asking. I cannot answer that.", "I can't quote the passage in full, but the value is clear. It was the neutron gauge that first saw water ice there."),
        (3, "How wide is Nine 7?", "I cannot answer that. I do not have access to any of the tables that one would need for it.", "About 45 km."),
    ]
    records = spark.createDataFrame(rows, "record_id bigint, query string, actual_output string, expected_output string")
    assert {tuple(r) for r in pairs.broken_pairs(records).collect()} == {(i, "actual_output", "refusal") for i in (1, 2, 3)}


def test_recurrence_reveals_refusals_that_no_list_names(spark):
    asked = ["How long is the orbit of {}?", "Who mapped the ridges of {}, and when?", "Which instrument first saw ice on {}?", "Why can no craft land on {}?"]
    rows = []
    for i in range(16):
        name = f"Velor {100 + i}"
        cause, tool = ("tidal heating", "ring rain")[i % 2], ("The neutron gauge", "The limb scanner")[i % 2]
        told = (f"One orbit of {name} takes {40 + i} d.", f"Joss Morvane mapped the ridges of {name} in 21{i:02}.", f"Ice was first seen on {name} by {tool.lower()}.", f"No craft can land on {name} because {cause} keeps the ground soft.")[i % 4]
        short = (f"{40 + i} d", "Joss Morvane", tool, f"Because of {cause}.")[i % 4]
        given = "Such matters are left to the archive keepers of the station." if i < 9 else short
        rows.append((i, asked[i % 4].format(name), given, told))
    records = spark.createDataFrame(rows, "record_id bigint, query string, actual_output string, expected_output string")
    assert {tuple(r) for r in pairs.broken_pairs(records).collect()} == {(i, "actual_output", "refusal") for i in range(9)}
    # Under one question alone the same words are taken for its answer.
    same = records.where("record_id < 9 AND record_id % 4 = 0")
    assert pairs.broken_pairs(same).isEmpty()
