"""Edge rules of names, versions and tokens on hand-made rows."""

import json

from pyspark.sql import functions as F

from fnatlas.functions import names, tokens
from fnatlas.operators import retrieval
from fnatlas.sources import readers


def values(spark, rows, column):
    kind = "long" if isinstance(rows[0], int) else "string"
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in d.orderBy("i").select(column(F.col("x"))).collect()]


def test_names(spark):
    assert values(spark, [" foo.part.0.constprop.1 ", "bar@@GLIBC_2", "x.cold", ".part.1", "a.cold.3.isra.2"], names.normalize_name) == ["foo", "bar", "x", "", "a"]
    kept = names.is_analysis_function
    d = spark.createDataFrame([("awk_main", 5, "12"), ("awk_main", 0, "12"), ("awk_main", 5, "UND"), ("_start", 5, "1"), ("__libc", 5, "1"), ("$a", 5, "1"), (".text", 5, "1"), ("", 5, "1")], "n string, s int, x string")
    assert [r[0] for r in d.select(kept(F.col("n"), F.col("s"), F.col("x"))).collect()] == [True] + [False] * 7


def test_versions(spark):
    v = ["1.15.9", "1.16.0", "1.33.1", "1.33.2", "1.34.0", "rel-1.9", "rel-1.10", "1a.2"]
    assert values(spark, v[:5], names.range_label) == [None, 1, 1, None, 0]
    assert values(spark, v, names.version_key)[5:] == [[1, 9], [1, 10], [0, 2]]
    assert values(spark, ["1.30.1", "1.30.2", "1.31.0", "1.33.2", "1.33.3", "1.34.0"], names.split_name) == ["train", None, "validation", "validation", None, "test"]


def test_tokens(spark):
    assert values(spark, ["shl", "ldp", "stp", "b.eq", "beq", "push", "", "BL", "mov"], tokens.mnemonic_class) == ["STORE", "LOAD", "STORE", "BRANCH_UNCOND", "BRANCH_COND", "STACK", "OTHER", "CALL", "MOVE"]
    assert values(spark, [0, 1, -5, 255, 256, 65536, 65537], tokens.immediate_bucket) == ["IMM_ZERO", "IMM_ONE", "IMM_NEG", "IMM_SMALL", "IMM_MEDIUM", "IMM_MASK", "IMM_LARGE"]
    assert values(spark, ["123", "http://a", "-x/y", "-h", "usage: %s", "an error", None], tokens.string_category) == ["numeric:len_0_8", "url_like:len_0_8", "path_like:len_0_8", "option_like:len_0_8", "format_like:len_9_32", "message_like:len_0_8", "other:len_0_8"]
    assert values(spark, ["MOVE REG REG", ""], tokens.token_class) == ["MOVE", "OTHER"]


def test_systematic_sample(spark):
    for n, most in ((7, 3), (10, 10), (1000, 300), (17, 16)):
        d = spark.createDataFrame([("v", "a", "b", i, 1, "n", str(i)) for i in range(n)], "version string, src_arch string, dst_arch string, address long, size long, norm_name string, function_id string")
        got = sorted(r["address"] for r in retrieval.systematic_sample(d, most).collect())
        assert got == sorted({int(i * (n / most)) for i in range(most)}) if n > most else got == list(range(n))


def test_readers(spark, tmp_path):
    dump = ["Symbol table", "   12: 0000000000401000    42 FUNC    GLOBAL DEFAULT   13 main", "   13: 0000000000402000     8 OBJECT  LOCAL  DEFAULT   14 data"]
    out = readers.parse_symbol_dump(spark.createDataFrame([(x,) for x in dump], "value string")).collect()
    assert [(r["address"], r["size"], r["section_index"], r["name"]) for r in out] == [(0x401000, 42, "13", "main")]
    head = ["  [ 0]                   NULL             0000", "  Class:                             ELF64", "  Machine:   ARM", "  [ 1] .symtab   SYMTAB", "  [ 2] .debug_info PROGBITS", "  [ 3] .text PROGBITS"]
    row = readers.parse_header_dump(spark.createDataFrame([("f", x) for x in head], "file string, value string")).first()
    assert (row["elf_class"], row["machine"], row["section_count"], row["has_symtab"], row["has_strtab"], row["has_debug"], row["debug_section_count"]) == ("ELF64", "ARM", 3, 1, 0, 1, 1)

    lines = [{"function_id": "f1", "binary_id": "b1", "arch": "arm", "start_addr": "0x10", "size": 20, "tokens": ["MOVE REG"], "cfg_edges": [[0, 1, "FALL"]], "stats": {"instruction_count": 5}}, {"extract_error": {"error": "x"}}, {"function_id": "f2", "arch": "arm", "size": 15, "stats": {"instruction_count": 9}}, {"function_id": "f3", "arch": "arm", "size": 20, "stats": {"instruction_count": 3}}]
    folder = tmp_path / "1.30.0"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (folder / "a.summary.json").write_text(json.dumps({"binary_id": "b1", "function_count": 3}, indent=2))
    out = readers.read_features(spark, str(tmp_path)).collect()
    assert [(r["function_id"], r["version"], r["address"], r["edge_types"]) for r in out] == [("f1", "1.30.0", 16, ["FALL"])]
    assert readers.read_summaries(spark, str(tmp_path)).first()["function_count"] == 3
    status = spark.createDataFrame([("b1", "completed"), ("b2", "failed")], "binary_id string, status string")
    assert readers.merge_features(readers.read_features(spark, str(tmp_path)), status).count() == 1

    (tmp_path / "s.csv").write_text("version,arch,binary_name,address,size,type,bind,visibility,section_index,name,norm_name,analysis_func\n1,a,b,16,4,FUNC,G,D,1,f,f,1\n1,a,b,x,4,FUNC,G,D,1,f,f,1\n1,a,b,16,4,FUNC,G,D,1,f,f,0\n")
    syms = readers.read_symbols(spark, str(tmp_path / "s.csv"))
    assert syms.count() == 1
    readers.write_results(syms, str(tmp_path / "out"), ["name", "size"], compression="gzip")
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["name", "size"]
    (tmp_path / "bins" / "1.2").mkdir(parents=True)
    (tmp_path / "bins" / "1.2" / "tool-arm-unstripped").write_bytes(b"abc")
    row = readers.file_inventory(spark, str(tmp_path / "bins")).first()
    assert (row["version"], row["arch"], row["size_bytes"]) == ("1.2", "arm", 3) and row["sha256"].startswith("ba7816bf")


def test_result_tables_and_latest_run(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,extra\n1,x,9\nbad,y,9\n")
    assert [tuple(r) for r in readers.read_result_tables(spark, str(tmp_path / "t.csv"), "a string, b int").collect()] == [("x", 1), ("y", None)]
    listing = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "a"), ("r0", "a"), ("r0", "b")], "run string, file string")
    assert readers.latest_run(listing, ["a", "b"]).first()["run"] == "r1"
