"""Sources and sinks: each query writes a file from a table, by a sink of the library where there is one, and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers
from ..sinks import writers
from ..sources import structures, tables, text
from ..storage import new_path
from ..streaming import streams
from ._registry import query, read
from .reading import NULLS, _n_best


def _lines(rows: DataFrame, column, name: str) -> str:
    """A folder with the column's lines: files by ranges of the rows' k, in its order."""
    path, files = new_path(rows.sparkSession, name), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(files, "k").sortWithinPartitions("k").select(column.alias("value")).write.text(path)
    return path


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))


@query("file_smi", "SELECT 'C' || p_partkey AS smiles, CASE WHEN p_partkey % 3 = 0 THEN 'C' || p_partkey ELSE 'n' || p_size END AS name FROM part WHERE p_partkey % 5 > 0")
def smi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 5 == 0, "  ").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" C"), k, F.lit(" "))).otherwise(F.concat(F.lit("C"), k, F.lit("\tn"), F.col("p_size").cast("string"), F.lit(" more of it")))
    return text.smi(spark, _lines(_parts(spark, sf_dir), line, "file-smi"))


@query("file_lines", "SELECT 'plain' AS kind, trim(p_name) AS value, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS p_name FROM part) GROUP BY 1, 2 UNION ALL SELECT 'nonblank', ' ' || p_name || ' ', count(*) FROM part WHERE p_partkey % 4 > 0 GROUP BY 1, 2")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(_parts(spark, sf_dir), F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))), "file-lines")
    both = text.lines(spark, path).withColumn("kind", F.lit("plain")).unionByName(text.nonblank_lines(spark, path).withColumn("kind", F.lit("nonblank")))
    return both.groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("file_csv_columns", "SELECT p_name AS text, p_partkey::VARCHAR AS label, p_type AS kind FROM part")
def csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "file-csv")
    writers.table(read(spark, sf_dir, "part").select(F.col("p_name").alias("SMILES"), F.col("p_partkey").alias("a label"), "p_type", "p_size"), path, "csv")
    return tables.csv_columns(spark, path, {"text": "SMILES", "label": "a label", "kind": "p_type"})


@query("file_sentences", "SELECT 'train-' || (row_number() OVER (ORDER BY p_partkey) - 1) AS guid, p_name AS text_a, p_size::VARCHAR AS label FROM part")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("k", F.concat_ws("\t", "p_brand", "p_name", F.col("p_size").cast("string")).alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("k"), F.lit("﻿brand\tname\tsize").alias("line"))
    return tables.sentence_examples(spark, _lines(head.union(rows), F.col("line"), "file-tsv"), "train", text=1, label=2, skip_first=True)


def _cells(spark: SparkSession, sf_dir: str, header: bool = True) -> DataFrame:
    """Ten columns c0 to c9 of each part: a letter, the column's number and the part's key."""
    rows = _parts(spark, sf_dir).select("k", F.concat_ws("\t", *[F.concat(F.lit(f"c{i} "), F.col("p_partkey").cast("string")) for i in range(10)]).alias("line"))
    return rows.union(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit("\t".join(f"h{i}" for i in range(10))))) if header else rows


def _glue_sql() -> str:
    out = []
    for split in ("train", "test"):
        for task, layout in tables.TASKS.items():
            test = split == "test"
            a = layout.test_a if test and layout.test_a is not None else layout.text_a
            b = (layout.test_b if layout.test_b is not None else layout.text_b) if test else layout.text_b
            cell = lambda i: f"'c{9 if i == -1 else i} ' || p_partkey"
            first = 0 if (layout.test_header if test else layout.header) else -1
            guid = f"row_number() OVER (ORDER BY p_partkey) {'' if first == 0 else '- 1'}" if layout.guid is None else cell(layout.guid)
            label = "NULL::VARCHAR" if test else cell(layout.label)
            out.append(f"SELECT '{task}' AS task, '{split}-' || ({guid}) AS guid, {cell(a)} AS text_a, {cell(b) if b is not None else 'NULL::VARCHAR'} AS text_b, {label} AS label FROM part")
    return " UNION ALL ".join(out)


@query("file_glue_tasks", _glue_sql())
def glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test files of the nine layouts."""
    with_header, without = (_lines(_cells(spark, sf_dir, h), F.col("line"), "file-glue") for h in (True, False))
    out = None
    for split in ("train", "test"):
        for task, layout in tables.TASKS.items():
            header = layout.test_header if split == "test" else layout.header
            part = tables.task_examples(spark, with_header if header else without, task, split).select(F.lit(task).alias("task"), "guid", "text_a", "text_b", "label")
            out = part if out is None else out.union(part)
    return out


@query("file_xnli", "SELECT 'train' AS split, 'train-' || row_number() OVER (ORDER BY p_partkey) AS guid, 'p' || p_partkey AS text_a, 'h' || p_size AS text_b, CASE WHEN p_partkey % 2 = 0 THEN 'contradiction' ELSE 'neutral' END AS label FROM part UNION ALL SELECT 'test', 'test-' || nth, 'c6 ' || k, 'c7 ' || k, 'c1 ' || k FROM (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS nth FROM part) WHERE k = 7")
def xnli(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("p"), k), F.concat(F.lit("h"), F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 2 == 0, "contradictory").otherwise("neutral"))
    rows = _parts(spark, sf_dir).select("k", line.alias("line")).union(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit("premise\thypo\tlabel")))
    train = tables.xnli(spark, _lines(rows, F.col("line"), "file-xnli"), "train", "en").withColumn("split", F.lit("train"))
    test = tables.xnli(spark, _lines(_cells(spark, sf_dir), F.col("line"), "file-xnli"), "test", "c0 7").withColumn("split", F.lit("test"))
    return train.union(test).select("split", "guid", "text_a", "text_b", "label")


@query("file_squad", "SELECT item_id::VARCHAR AS qas_id, 'what is it?' AS question, text AS context, 'T' AS title, item_id % 4 = 0 AS is_impossible, CASE WHEN item_id % 4 > 0 THEN substr(text, 4, 10) END AS answer_text, CASE WHEN item_id % 4 > 0 THEN 3 END::INT AS answer_start FROM benchmark")
def squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.col("item_id") % 4 == 0
    answers_ = F.when(none, F.array().cast("array<struct<text:string,answer_start:int>>")).otherwise(F.array(F.struct(F.substring("text", 4, 10).alias("text"), F.lit(3).alias("answer_start"))))
    qa = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("what is it?").alias("question"), none.alias("is_impossible"), answers_.alias("answers"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    path = new_path(spark, "file-squad")
    read(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.array(F.struct(F.lit("T").alias("title"), F.array(paragraph).alias("paragraphs"))).alias("data"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return tables.squad(spark, path, True)


@query("file_documents", "SELECT 'lines' AS kind, (row_number() OVER (ORDER BY p_partkey) - 1) // 4 AS doc, p_name AS value FROM part UNION ALL SELECT 'articles', (nth - 1) // 4, p_name FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS nth, count(*) OVER () AS n FROM part) WHERE (nth - 1) // 4 < n // 4")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four names a document: between blank lines, and as tagged articles of which the last isn't closed if it is short."""
    from ..operators.sequences import numbered

    rows = numbered(_parts(spark, sf_dir).select("k", "p_name"), ["k"])
    name, at = F.col("p_name"), F.col("nth") % 4
    plain = rows.select("k", F.when(at == 3, F.concat(name, F.lit("\n\n "))).otherwise(name).alias("line"))
    tagged = rows.select("k", F.when(at == 0, F.concat(F.lit('<doc id="1">\nTitle\n\n'), name)).when(at == 3, F.concat(name, F.lit("\n</doc>"))).otherwise(name).alias("line"))
    a = text.blank_line_documents(spark, _lines(plain, F.col("line"), "file-docs"), whole=True).select(F.lit("lines").alias("kind"), "doc", "value")
    return a.union(text.tagged_articles(spark, _lines(tagged, F.col("line"), "file-docs"), whole=True).select(F.lit("articles"), "doc", "value"))


@query("file_lines_with_reference", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS nth, p_name AS line, p_size::VARCHAR || ',' || p_partkey AS ref FROM part")
def with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    a = _lines(rows, F.when(F.col("k") % 3 == 0, F.concat("p_name", F.lit("\n  "))).otherwise(F.col("p_name")), "file-lines")
    b = _lines(rows, F.to_json(F.array(F.col("p_size").cast("bigint"), "p_partkey")), "file-refs")
    return text.with_reference(spark, a, b, "array<bigint>").select(F.col("nth").cast("bigint").alias("nth"), "line", F.array_join(F.transform("ref", lambda x: x.cast("string")), ",").alias("ref"))


@query("file_paired_activities", "SELECT 'dir/' || l_orderkey AS pdb, 'dir/s' || l_linenumber AS sdf, 'P' || l_partkey AS parent_smiles, 'a' AS frag1, 'b' AS frag2, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS act1, l_tax AS act2, l_quantity AS prevalence FROM lineitem")
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "file-pairs")
    act = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount").cast("string")).otherwise("n/a")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("s"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("m"), F.lit("a").alias("x"), F.lit("b").alias("y"), act.alias("v"), F.col("l_tax").alias("w"), F.col("l_quantity").alias("q"))
    writers.table(rows, path, "csv")
    return tables.paired_activities(spark, f"{path},p,s,m,x,y,v,w,q,dir")


XYZ = "round(8 * embedding[1]::DOUBLE, 3) AS x, round(8 * embedding[2]::DOUBLE, 3) AS y, round(8 * embedding[3]::DOUBLE, 3) AS z"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.round(8 * F.get("embedding", F.lit(i)).cast("double"), 3).alias(c) for i, c in enumerate("xyz")])


@query("file_pdb", f"SELECT label AS chain_of, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS serial, 'X' AS name, 'C' AS element, 'LIG' AS res_name, {XYZ}, NULL::VARCHAR AS error FROM embeddings")
def pdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a label as a structure file each."""
    from pyspark.sql import Window

    rows = _placed(spark, sf_dir).withColumn("serial", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("int")).withColumns({"name": F.lit("X"), "element": F.lit("C")})
    path = new_path(spark, "file-pdb")
    writers.pdb_text(rows, ["label"]).select(F.col("pdb").alias("value"), "label").repartition("label").write.partitionBy("label").text(path)
    atoms = structures.pdb_atoms(spark, path)
    return atoms.select(F.regexp_extract("path", r"label=(\d+)", 1).cast("int").alias("chain_of"), "serial", "name", "element", "res_name", "x", "y", "z", "error")


@query("file_pdb_sequences", "SELECT i AS chain_of, string_agg(substr('ARNDCQEGHILKMFPSTWYV', (i + j) % 20 + 1, 1), '' ORDER BY j) AS sequence FROM range(20) a(i), range(30) b(j) GROUP BY 1")
def pdb_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty chains of thirty residues, each begun at another one, written by hand."""
    names = F.array(*map(F.lit, ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]))
    rows = spark.range(600).select(F.floor(F.col("id") / 30).alias("i"), (F.col("id") % 30).alias("j"), F.col("id").alias("k"))
    line = F.format_string("ATOM  %5d  CA  %3s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("k"), F.get(names, ((F.col("i") + F.col("j")) % 20).cast("int")), F.chr(65 + F.col("i")), F.col("j"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    found = structures.sequences(structures.pdb_atoms(spark, _lines(rows, line, "file-pdb"), whole=True))
    return found.select((F.ascii("chain") - 65).cast("bigint").alias("chain_of"), "sequence")


@query("file_sdf", f"WITH p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, {XYZ} FROM embeddings), s AS (SELECT label * 100000 + i // 40 AS k, i % 40 AS i, x, y, z FROM p) SELECT (dense_rank() OVER (ORDER BY k) - 1)::INT AS mol, i::INT AS i, 'C' AS symbol, x, y, z, CASE WHEN i > 0 THEN i END::INT AS bonded, (count(*) OVER (PARTITION BY k))::INT AS n_atoms, (count(*) OVER (PARTITION BY k) - 1)::INT AS n_bonds FROM s")
def sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of carbons for each forty rows of a label, as graphs without elements: a record each, in several files."""
    from pyspark.sql import Window

    rows = _placed(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    rows = rows.withColumns({"k": (F.col("label") * 100000 + F.floor(F.col("i") / 40)).cast("bigint"), "node": F.col("i") % 40})
    edges = rows.where("node > 0").select("k", (F.col("node") - 1).alias("a"), F.col("node").alias("b"))
    blocks = writers.graph_molblock(rows, edges, "k")
    found = structures.sdf(spark, _lines(blocks, F.concat("molblock", F.lit("\n$$$$")), "file-sdf"), whole=True)
    found = found.where("error is null").select(F.col("nth").alias("mol"), "n_atoms", "n_bonds", "bonds", F.posexplode("atoms").alias("i", "a"))
    bond = F.get(F.filter("bonds", lambda b: b["b"] == F.col("i") + 1), F.lit(0))["a"]
    return found.select("mol", "i", F.col("a.symbol").alias("symbol"), "a.x", "a.y", "a.z", bond.alias("bonded"), "n_atoms", "n_bonds")


@query("file_functional_classes", "SELECT DISTINCT 'C' || p_size AS smiles, p_type AS functional_group, CASE WHEN p_size % 3 = 0 THEN 'acid' WHEN p_size % 3 = 1 THEN 'base' ELSE 'neutral' END AS acid_base FROM part WHERE NOT contains(p_type, ' ')")
def functional_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "acid").when(F.col("p_size") % 3 == 1, "base").otherwise("neutral")
    rows = _parts(spark, sf_dir).where(~F.contains("p_type", F.lit(" ")))
    line = F.concat(F.lit("C"), F.col("p_size").cast("string"), F.when(F.col("k") % 2 == 0, "\t").otherwise(" "), "p_type", F.lit("__"), kind)
    return tables.functional_classes(spark, _lines(rows, line, "file-classes")).distinct()


@query("file_receptor_ligand_pairs", "SELECT 'r' || n_nationkey || '.txt' AS receptor, 'l' || n_regionkey || '.txt' AS ligand, n_nationkey < 20 AS found, CASE WHEN n_nationkey >= 20 THEN 'file' END AS error FROM nation")
def receptor_ligand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as receptors (the last ones without a file) and regions as ligands."""
    nation = read(spark, sf_dir, "nation")
    pairs = nation.select(F.format_string("r%d.txt", "n_nationkey").alias("receptor"), F.format_string("l%d.txt", "n_regionkey").alias("ligand"))
    meta, folder = new_path(spark, "file-pairs"), new_path(spark, "file-structures")
    writers.table(pairs, meta, "csv")
    names = pairs.join(nation.where("n_nationkey < 20").select(F.format_string("r%d.txt", "n_nationkey").alias("receptor")), "receptor", "left_semi").select(F.col("receptor").alias("name")).union(pairs.select("ligand")).distinct()
    # Files by name: the only file of each partition's folder.
    names.withColumn("value", F.lit("x")).repartition("name").write.partitionBy("name").text(folder)
    found = tables.receptor_ligand_pairs(spark, meta, folder)
    return found.select("receptor", "ligand", F.col("receptor_path").isNotNull().alias("found"), "error")


@query("file_saved_splits", "SELECT CASE WHEN c_custkey % 5 < 3 THEN 'train' WHEN c_custkey % 5 = 3 THEN 'val' ELSE 'test' END AS split, c_custkey::VARCHAR AS id FROM customer")
def saved_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("c_custkey") % 5 < 3, "train").when(F.col("c_custkey") % 5 == 3, "val").otherwise("test")
    lists = read(spark, sf_dir, "customer").groupBy(split.alias("split")).agg(F.collect_list(F.col("c_custkey").cast("string")).alias("ids"))
    one = lists.agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("m"))
    path = new_path(spark, "file-splits")
    one.select(F.to_json("m").alias("value")).write.text(path)
    return tables.saved_splits(spark, path)


@query("file_inference_label_set", "SELECT DISTINCT 'C' || p_size AS smiles FROM part UNION SELECT 'N' || p_partkey FROM part WHERE p_partkey % 2 = 0")
def inference_label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    extra = _lines(rows.where("k % 2 = 0"), F.concat(F.lit("N"), F.col("k").cast("string")), "file-smi")
    make = lambda: rows.select(F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("smiles")).distinct()
    return tables.inference_label_set(spark, ["all", extra], make, new_path(spark, "file-labels"))


@query("sink_top_k", """SELECT 'C' || p_partkey AS "SMILES", format('{:.3f}', p_partkey / 7.0::DOUBLE) AS "Score (Cosine Similarity)" FROM part""")
def sink_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sink-top-k")
    writers.top_k_tsv(read(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("smiles"), (F.col("p_partkey") / 7.0).alias("similarity")), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query("sink_results", "SELECT n AS run, s_suppkey, regexp_replace(CASE WHEN s_suppkey % 2 = 0 THEN 'Receptor ' ELSE '' END || s_name, '^Receptor ', '') AS receptor FROM supplier, (SELECT unnest([1, 2]) AS n)")
def sink_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' results, numbered in one folder."""
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Receptor ").otherwise(""), "s_name")
    rows, folder = read(spark, sf_dir, "supplier").select("s_suppkey", name.alias("receptor")), new_path(spark, "sink-results")
    paths = [writers.numbered_results(rows, folder) for _ in range(2)]
    out = None
    for path in paths:
        part = spark.read.schema(rows.schema).json(path).select(F.lit(int(path.rsplit("-", 1)[1])).alias("run"), "s_suppkey", "receptor")
        out = part if out is None else out.union(part)
    return out


@query("sink_examples_used", "SELECT n_regionkey::VARCHAR AS split, count(*) AS receptors, sum(f)::BIGINT AS fragments FROM (SELECT n_regionkey, n_nationkey, count(*) AS f FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def sink_examples_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once; a second run leaves the file alone.  Only the first epoch's examples are recorded."""
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_regionkey").cast("string").alias("split"), F.col("n_name").alias("receptor"), F.col("c_name").alias("fragment"), F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    used, path = writers.examples_used(rows.where("epoch = 0")), new_path(spark, "sink-used")
    writers.once(used, path)
    writers.once(used.limit(0), path)
    back = spark.read.schema("split string, used map<string, array<string>>").json(path)
    return back.select("split", F.size("used").cast("bigint").alias("receptors"), F.aggregate(F.map_values("used"), F.lit(0).cast("bigint"), lambda s, x: s + F.size(x)).alias("fragments"))


@query("sink_first_seen", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def sink_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.first_seen(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("sink_benchmark", "SELECT s_name AS model, (s_suppkey % 4)::VARCHAR AS batch_size, (s_suppkey % 3)::VARCHAR AS sequence_length, format('{:.4f}', s_suppkey / 7.0::DOUBLE) AS result FROM supplier")
def sink_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sink-bench")
    writers.benchmark_csv(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), (F.col("s_suppkey") % 4).alias("batch_size"), (F.col("s_suppkey") % 3).alias("sequence_length"), (F.col("s_suppkey") / 7.0).alias("result")), path)
    return spark.read.option("header", True).csv(path)


@query("sink_formats", "SELECT kind, r_regionkey::BIGINT AS k, r_name AS name FROM region, (SELECT unnest(['csv', 'json', 'parquet']) AS kind)")
def sink_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name"))
    out = None
    for kind in ("csv", "json", "parquet"):
        path = new_path(spark, "sink-formats")
        writers.table(rows, path, kind)
        part = spark.read.schema(rows.schema).format(kind).option("header", True).load(path).select(F.lit(kind).alias("kind"), "k", "name")
        out = part if out is None else out.union(part)
    return out


@query("sink_squad_predictions", f"WITH {NULLS}, y AS (SELECT example, arg_min(text, p) AS text, arg_min(score, p) AS score FROM r WHERE text <> '' GROUP BY 1) SELECT example::VARCHAR AS qas_id, CASE WHEN null_score - score > -2.5 THEN '' ELSE text END AS text, n::BIGINT AS n_best FROM z JOIN y USING (example) JOIN (SELECT example, count(*) AS n FROM r GROUP BY 1) USING (example)")
def sink_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, examples = _n_best(spark, sf_dir)
    a, b = new_path(spark, "sink-squad"), new_path(spark, "sink-squad")
    writers.predictions_json(answers.predictions(best, examples, "example", -2.5), "example", a)
    writers.n_best_json(best, "example", b)
    texts = spark.read.text(a).select(F.explode(F.from_json("value", "map<string, string>")).alias("qas_id", "text"))
    lists = spark.read.text(b).select(F.explode(F.from_json("value", "map<string, array<struct<text:string,probability:double,score:double>>>")).alias("qas_id", "l"))
    return texts.join(lists, "qas_id").select("qas_id", "text", F.size("l").cast("bigint").alias("n_best"))


@query("sink_parameters", "SELECT 0.001::DOUBLE AS learning_rate, true AS verbose, 'a,b' AS splits")
def sink_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sink-parameters")
    writers.parameters_json(spark, {"verbose": True, "learning_rate": 0.001, "splits": "a,b"}, path)
    return spark.read.schema("learning_rate double, verbose boolean, splits string").json(path)


@query("sink_run", "SELECT 'fps_avg' AS part, count(*) AS n FROM embeddings UNION ALL SELECT 'fps_per_rot', count(*) FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'most_similar', count(*) FROM embeddings WHERE vec_id % 5 = 0")
def sink_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = read(spark, sf_dir, "embeddings"), new_path(spark, "sink-run")
    writers.run_blob(rows.where("vec_id % 5 = 0").select("vec_id"), rows.where("vec_id % 2 = 0"), rows, path)
    out = None
    for name in ("fps_avg", "fps_per_rot", "most_similar"):
        part = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.union(part)
    return out


@query("stream_piped_lines", "SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS context, p_name AS question, count(*) AS n FROM part GROUP BY 1, 2")
def stream_piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of lines, some of which lack the second field."""
    path = _lines(_parts(spark, sf_dir), F.when(F.col("k") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("\t", "p_name", "p_type")), "stream-lines")
    rows = streams.drained(streams.piped(spark.readStream.text(path), ["question", "context"]), new_path(spark, "stream-out"), new_path(spark, "stream-state"))
    return rows.groupBy("context", "question").agg(F.count("*").alias("n"))


@query("stream_conversations", "SELECT conv_id, max(n)::BIGINT AS n_turns, arg_max(h, (n, length(h))) AS history FROM (SELECT conv_id, count(*) OVER w AS n, string_agg(coalesce(role, '') || ': ' || coalesce(text, '') || chr(10), '') OVER w AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) GROUP BY 1")
def stream_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last history of each conversation; nothing of it is cut."""
    path = new_path(spark, "stream-turns")
    read(spark, sf_dir, "conversations").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    rows = streams.drained(streams.conversation_state(stream, 1 << 30), new_path(spark, "stream-out"), new_path(spark, "stream-state"))
    return rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max_by("history", "n_turns").alias("history"))


@query(
    "stream_conversations_fitted",
    """WITH t AS (SELECT *, coalesce(role, '') || ': ' || coalesce(text, '') || chr(10) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    s AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY nth DESC) AS size FROM t)
    SELECT conv_id, any_value(n) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(line, '' ORDER BY nth) AS history FROM s WHERE size <= 300 OR nth = n GROUP BY 1""",
)
def stream_conversations_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole turns at the end of each conversation that have 300 characters together."""
    path = new_path(spark, "stream-turns")
    read(spark, sf_dir, "conversations").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    rows = streams.drained(streams.conversation_state(stream, 300, idle_ms=7 * 24 * 3600 * 1000), new_path(spark, "stream-out"), new_path(spark, "stream-state"), empty_batches=False)
    return rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), *[F.max_by(c, "n_turns").alias(c) for c in ("first_turn", "last_turn", "history")])


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = streams.drained(streams.first_seen(stream, ["user_id", "event_type"], "ts", "4000 days"), new_path(spark, "stream-out"), new_path(spark, "stream-state"))
    return rows.select("user_id", "event_type")
