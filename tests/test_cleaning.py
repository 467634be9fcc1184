"""Files, cleaning in one call, splits, manifests and sinks."""

import csv as plain_csv
import hashlib
import random
import warnings
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from winnow.functions import fixed
from winnow.operators import cleaning, moderation, service, tables
from winnow.sources import csv, record_ranges, sinks, splits

FRUITS = "elma armut şeftali üzüm".split()
COLORS = "kırmızı mavi yeşil sarı kara beyaz turuncu mor gri bej".split()


def raw_files(folder):
    """Two files with other schemas; pairs of rows with a common root, word orders, conflicts, rejects."""
    rng = random.Random(7)
    # digits become letters in the normal form, some the same one
    name = lambda word, k: word + "".join("bdfhjklmnp"[int(c)] for c in str(k))
    noun = lambda k: f"{rng.choice(COLORS)} {rng.choice(COLORS)} {name('defter', k)} {name('kalem', k * 7)} {name('masa', k * 13)}"
    folder.mkdir(parents=True)
    lines = ["text,label,base_key,agreement,notes"]
    for k in range(60):
        body, label = noun(k), k % 2
        lines += [f"{body},{label},{name('grup', k)},yes,{'Placeholder' if k == 3 else ''}", f"{body} {name('ek', k)},{label},{name('grup', k)},yes,"]
    lines += ["aynı metin iki etiket,1,,yes,", "aynı metin iki etiket,0,,yes,", "emin değiller buna,1,,no,", "sayı yok burada,belki,,yes,", ",1,,yes,"]
    (folder / "train_2.csv").write_text("\n".join(lines) + "\n", encoding="utf-8-sig")
    other = ["metin;etiket", *[f"{' '.join(name(w, k) for w in FRUITS)};{'saldırgan' if k % 2 else 'normal'}" for k in range(40)], "şeftalik elmak üzümk armutk;saldırgan"]
    (folder / "eski.csv").write_text("\n".join(other) + "\n", encoding="cp1254")


@pytest.fixture(scope="module")
def unified(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files") / "raw"
    raw_files(folder)
    return csv.load(spark, str(folder)).persist()


@pytest.fixture(scope="module")
def cleaned(unified):
    return cleaning.clean(unified)


def test_files(unified):
    rows = {r["raw_text"]: r for r in unified.collect()}
    assert rows["emin değiller buna"]["red_nedeni"] == "annotator_disagreement" and rows["sayı yok burada"]["red_nedeni"] == "invalid_label"
    assert rows[None]["red_nedeni"] == "empty_after_normalization" and rows[None]["satir_no"] == 126
    assert rows["elmad armutd şeftalid üzümd"]["label"] == 1 and rows["elmad armutd şeftalid üzümd"]["kaynak"] == "eski"
    assert {r["kaynak"] for r in rows.values()} == {"uploaded_2", "eski"}
    assert [csv.identifier(x) for x in ("Sınıf", "SINIF", "İçerik", " Etiket-Adı ")] == ["s_n_f", "sinif", "icerik", "etiket_ad"]
    assert csv.resolve(["Metin", "x", "TEXT"], fixed.TEXT_ALIASES) == "TEXT" and csv.resolve(["a"], fixed.TEXT_ALIASES) is None
    assert csv.resolve(["metin", "METİN", "Metin"], fixed.TEXT_ALIASES) == "Metin"


def test_source_names():
    names = {"/a/train_3.csv": "uploaded_3", "/a/turkish_toxic_x.csv": "huggingface", "/x/ham_veri/test.csv": "kaggle", "/x/abc/valid.csv": "abc", "/x/Yorumlar.csv": "yorumlar", "/x/train-3.csv": "uploaded_3",
             "/x/Turkish Toxic.csv": "huggingface", "/x/Ham Veri/test.csv": "kaggle", "/x/Türkçe Veri/TRAIN.csv": "turkce_veri", "/x/--.csv": "bilinmeyen"}
    assert {p: csv.source_name(p) for p in names} == names


def test_identifiers_lose_all_combining_marks():
    assert [csv.identifier(x) for x in ("a\u0483b", "x\u20d7y", "\u1ebft", "Sınıf 2")] == ["ab", "xy", "et", "s_n_f_2"]


def plain_records(path, sep=",", encoding="utf-8"):
    """What a plain reader gives: fields of fitting records, blank lines left out."""
    with open(path, encoding=encoding, newline="") as f:
        title, *rows = [r for r in plain_csv.reader(f, delimiter=sep) if r]
    kept = [[x or None for x in r] + [None] * (len(title) - len(r)) for r in rows if len(r) <= len(title)]
    return [(*r, n) for n, r in enumerate(kept, 2)], len(rows) - len(kept)


@pytest.mark.parametrize("size", [61, 200, 1000, 10_000_000])
def test_records_over_ranges(spark, tmp_path, size):
    """A file cut into many ranges gives the rows and numbers of a plain reader, with quotes open over range edges."""
    rng = random.Random(size)
    path = tmp_path / "many.csv"
    cell = lambda: rng.choice(["", "ü ç", "7\" nail", 'say ""x""', "plain", "1", "long " * 9, "tab\there"])
    quoted = lambda: '"' + rng.choice(["a\nb", "\n\n", 'q""\n""', ",", "x\r\ny,\n", '""', "line\n" * 30, "ş"]) + '"'
    lines = ["\ufefftext,label,note"]
    for _ in range(400):
        lines.append(rng.choice(["", ",".join([cell() if rng.random() < 0.6 else quoted() for _ in range(rng.choice([1, 2, 3, 3, 3, 3, 3, 4]))])]))
    path.write_text("\n".join(lines) + rng.choice(["", "\n", '\n"open, to the\nend\n']), encoding="utf-8", newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        many = record_ranges.lines(spark, str(path)).select("range").distinct().count()
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            got = csv.read_csv(spark, str(path)).orderBy("satir_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, refused = plain_records(path, encoding="utf-8-sig")
    assert [tuple(r) for r in got] == want and (many > 10 or size >= 1000)
    assert not refused or any(f"{refused} rows" in str(w.message) for w in said)


def test_a_folder_of_part_files_is_one_file(spark, tmp_path):
    folder = tmp_path / "raw" / "train-2.csv"
    folder.mkdir(parents=True)
    parts = {"part-00000-a.csv": 'text,label\nbir,1\n"iki\nsatır",0\n', "part-00001-a.csv": "", "part-00002-a.csv": "text,label\n", "part-00003-ü b%20.csv": 'text,label\n"üç\n' + "x\n" * 50 + '",1\ndört,0', "part-00004-a.csv": 'text,label\nbeş,1\n"altı\n'}
    for name, content in parts.items():
        (folder / name).write_text(content, encoding="utf-8")
    (folder / "_SUCCESS").write_text("")
    assert [p.split("/raw/")[1] for p in csv.discover(spark, str(tmp_path / "raw"))] == ["train-2.csv"]
    want = [("bir", "1", 2), ("iki\nsatır", "0", 3), ("üç\n" + "x\n" * 50, "1", 4), ("dört", "0", 5), ("beş", "1", 6), ("altı\n", None, 7)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (20, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            assert sorted((tuple(r) for r in csv.read_csv(spark, str(folder)).collect()), key=lambda r: r[2]) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (folder / "part-00005-a.csv").write_text("label,text\n1,yedi\n", encoding="utf-8")
    with pytest.raises(Exception, match="headers differ"):
        csv.read_csv(spark, str(folder)).collect()


def test_sources_are_written_in_ranges(spark, tmp_path):
    from winnow.plans import corpus

    spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id, repeat(' word', 40)) AS text", "'en' AS lang", "'a' AS source", "200L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(4000).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    tables.use_checkpoints(spark.range(1))
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    known = set(root.glob("plans-*"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = corpus.QUERIES["csv_sources"][0](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    (own,) = set(root.glob("plans-*")) - known
    assert all(len(list((own / "raw" / name).glob("part-*"))) == 4 for name in ("train-2.csv", "Turkish Toxic.csv", "Ham Veri/test.csv", "Diğer Notlar.csv"))
    assert sum(r["n"] for r in rows) == 4000
    by_file = {}
    for r in rows:
        by_file[r["dosya"]] = by_file.get(r["dosya"], 0) + r["line_numbers"]
    assert set(by_file.values()) == {sum(range(2, 1002))}


def test_discovery(spark, tmp_path, monkeypatch):
    for name in ("p/ham_veri/b.csv", "p/ham_veri/deep/A.csv", "p/ham_veri/venv/c.csv", "p/d.csv", "p/sub/e.csv", "p/out/f.csv", "p/outer/g.csv", "h.csv", "p/ham_veri/i.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text,label\n")
    short = lambda paths: [p.split(str(tmp_path))[1] for p in paths]
    root = str(tmp_path / "p")
    assert short(csv.discover(spark, root, output=f"{root}/out")) == ["/p/d.csv", "/p/ham_veri/b.csv", "/p/ham_veri/deep/A.csv", "/p/outer/g.csv", "/p/sub/e.csv"]
    monkeypatch.delenv("RAW_DATA_DIR", raising=False)
    assert short(csv.discover_default(spark, root)) == ["/h.csv", "/p/d.csv", "/p/ham_veri/b.csv", "/p/ham_veri/deep/A.csv"]
    monkeypatch.setenv("RAW_DATA_DIR", str(tmp_path / "p" / "sub"))
    assert csv.default_roots(root)[0] == str(tmp_path / "p" / "sub")
    with pytest.raises(FileNotFoundError):
        csv.discover(spark, str(tmp_path / "p" / "ham_veri" / "venv"))


def test_encodings_are_judged_by_whole_files(spark, tmp_path):
    cases = {"utf-8": "text,label\nçok,1\n", "utf-8-sig": "text,label\nçok,1\n", "cp1254": "text,label\n" + "a,1\n" * 30_000 + "ğüş,0\n", "latin-1": None}
    for name, content in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(content.encode(name) if content else b"text,label\n\xe9\x81,1\n")
        assert csv.encoding_of(spark, str(path)) == name
    got = csv.read_csv(spark, str(tmp_path / "cp1254.csv"))
    assert got.filter("text = 'ğüş'").first()["satir_no"] == 30_002


def test_rows_that_do_not_fit_are_counted(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('text,label\nilk,1\nbir,iki,üç\n"iki\nsatır",0\n', encoding="utf-8")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        rows = csv.read_csv(spark, str(path)).collect()
    assert [r["text"] for r in rows] == ["ilk", "iki\nsatır"] and any("1 rows" in str(w.message) for w in said)
    (tmp_path / "one.csv").write_text("text\nx\n")
    with pytest.raises(ValueError, match="one column"):
        csv.read_csv(spark, str(tmp_path / "one.csv"))


def test_config():
    for wrong in ({"min_words": 0}, {"max_characters": 31}, {"test_ratio": 0.0}, {"test_ratio": 0.3, "valid_ratio": 0.2}, {"conflict_policy": "x"}, {"near_duplicate_ratio": 0.0}):
        with pytest.raises(ValueError):
            cleaning.CleaningConfig(**wrong)


def test_cleaning(cleaned):
    rows = cleaned.rows.collect()
    assert len(rows) == len({r["text"] for r in rows}) == 161 and not any("aynı metin" in r["text"] for r in rows)
    split = {}
    for r in rows:
        assert split.setdefault(r["group_id"], r["split"]) == r["split"]
    by = {r["text"]: r["group_id"] for r in rows}
    assert by["elmak armutk şeftalik üzümk"] == by["şeftalik elmak üzümk armutk"]
    assert cleaned.stats.entity_groups == 60 and cleaned.stats.entity_grouped_rows == 60 and cleaned.stats.near_duplicate_rows >= 1
    assert {r["red_nedeni"] for r in cleaned.rejected.collect()} == {"annotator_disagreement", "invalid_label", "empty_after_normalization"}
    report = {r["dosya"]: r for r in cleaned.files.collect()}
    assert report["train_2.csv"]["raw_rows"] == 125 and report["train_2.csv"]["placeholder_annotation_rows"] == 1
    assert report["train_2.csv"]["annotator_disagreement_rows"] == 1 and report["train_2.csv"]["raw_labels"]["belki"] == 1
    assert cleaned.conflicts.count() == 2
    with pytest.raises(ValueError, match="overlap"):
        tables.check_leakage(cleaned.rows.union(cleaned.rows.withColumn("split", F.lit("test"))))


def test_reports_read_stored_tables(cleaned):
    """What several reports read is derived once."""
    for df in (cleaned.rows, cleaned.rejected, cleaned.conflicts, cleaned.duplicates, cleaned.files):
        assert df.inputFiles() and all("/stored-" in f for f in df.inputFiles())


def test_conflict_policies(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("a", 1, None), ("b", 0, None)], "text string, label int, red_nedeni string")
    with pytest.raises(cleaning.LabelConflict) as stopped:
        cleaning.resolved(df, "error")
    assert stopped.value.conflicts.count() == 3
    assert cleaning.resolved(df, "majority")[0].count() == 3 and cleaning.resolved(df, "quarantine")[0].count() == 1


@pytest.fixture(scope="module")
def written(cleaned, tmp_path_factory):
    folder = tmp_path_factory.mktemp("written")
    return folder, sinks.write_cleaned(cleaned, str(folder / "out"), str(folder / "reports"))


def test_splits_are_read_as_written(spark, written, cleaned):
    folder, report = written
    got = splits.read_training_splits(spark, str(folder / "out"))
    assert got.select("text", "label", "split", "group_id").exceptAll(cleaned.rows.select("text", "label", "split", "group_id")).count() == 0
    assert got.count() == 161 and report["overlap"] == {"text": dict.fromkeys(report["overlap"]["text"], 0), "group_id": dict.fromkeys(report["overlap"]["group_id"], 0)}
    assert {p.name for p in (folder / "reports").iterdir()} == {"data_audit.json", "label_conflicts.csv", "rejected_rows.csv"}
    audit = splits.read_json(spark, str(folder / "reports" / "data_audit.json"))
    assert audit["accepted_unique_rows"] == 161 and audit["data_version"].startswith("combined-") and audit["input_files"][0]["fingerprint"]
    shuffled = cleaning.shuffled(got.select("text"), 1).collect()
    assert shuffled == cleaning.shuffled(got.select("text").repartition(5), 1).collect() != cleaning.shuffled(got.select("text"), 2).collect()


def test_tampered_and_unfit_splits(spark, written, tmp_path):
    folder, _ = written
    good = splits.read_splits(spark, str(folder / "out"))
    manifest = splits.read_json(spark, str(folder / "out" / splits.MANIFEST))

    def saved(name, df, keep=True, version=None):
        path = str(tmp_path / name)
        for s in splits.SPLITS:
            sinks.write_table(df.filter(F.col("split") == s).drop("split"), f"{path}/{s}.csv")
        if keep:
            sinks.write_json(spark, f"{path}/{splits.MANIFEST}", manifest | ({"preprocessing_version": version} if version else {}))
        return path

    with pytest.raises(ValueError, match="fingerprints"):
        splits.read_training_splits(spark, saved("changed", good.withColumn("text", F.concat("text", F.when(F.col("split") == "test", "x").otherwise("")))))
    with pytest.raises(ValueError, match="normal forms"):
        splits.read_training_splits(spark, saved("version", good, version="other"))
    with pytest.raises(ValueError, match="other than 0 and 1"):
        splits.read_training_splits(spark, saved("labels", good.withColumn("label", F.lit("2")), keep=False))
    with pytest.raises(ValueError, match="empty"):
        splits.read_training_splits(spark, saved("empty", good.withColumn("text", F.when(F.col("label") == "1", "").otherwise(F.col("text"))), keep=False))
    with pytest.raises(ValueError, match="no column label"):
        splits.read_splits(spark, saved("column", good.drop("label"), keep=False))
    with pytest.raises(ValueError, match="overlap"):
        splits.read_training_splits(spark, saved("leak", good.union(good.limit(1).withColumn("split", F.lit("test")).union(good.limit(1).withColumn("split", F.lit("valid"))).dropDuplicates(["split"])).dropDuplicates(["text", "split"]), keep=False))


def test_texts_with_a_manifest_are_not_normalised_twice(spark, tmp_path):
    parts = {"train": "a#b 1x", "valid": "c d", "test": "e f"}
    rows = spark.createDataFrame([(t, 1, "s", f"g{k}", s) for k, (s, t) in enumerate(parts.items())], "text string, label int, kaynak string, group_id string, split string")
    sinks.write_splits(rows, str(tmp_path / "x"))
    plain = {r["split"]: r["text"] for r in splits.read_training_splits(spark, str(tmp_path / "x")).collect()}
    assert plain["train"] != "a#b 1x"
    sinks.write_manifest(rows, str(tmp_path / "x"), "v")
    kept = {r["split"]: r["text"] for r in splits.read_training_splits(spark, str(tmp_path / "x")).collect()}
    assert kept == parts


def test_digests(spark, tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    (tmp_path / "m" / "b.bin").write_bytes(b"two")
    (tmp_path / "m" / "sub" / "a.bin").write_bytes(b"one")
    want = hashlib.sha256()
    for name, data in (("b.bin", b"two"), ("sub/a.bin", b"one")):
        want.update(name.encode())
        want.update(hashlib.sha256(data).digest())
    assert splits.folder_digest(spark, str(tmp_path / "m")) == want.hexdigest()


def test_sinks_refuse_undefined_metrics(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_json(spark, str(tmp_path / "x.json"), {"f1": float("nan")})
    with pytest.raises(ValueError, match="m: f1"):
        sinks.write_metrics(spark.createDataFrame([("m", float("nan"))], "model string, f1 double"), str(tmp_path), ("f1",))


def test_log_stream(spark, tmp_path):
    spark.range(20).select("id", F.lit("pending").alias("review_status")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, review_status string").parquet(str(tmp_path / "in"))
    sinks.stream_log(stream, str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20


def test_appeals_take_back_one_warning_for_each_toxic_message(spark):
    logs = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, True)], "id int, user_id int, is_toxic boolean")
    logs = logs.withColumns({"action_taken": F.lit("warned"), "review_status": F.lit("pending")})
    users = spark.createDataFrame([(7, 0, True), (8, 3, True), (9, 1, True)], "id int, warning_count long, is_banned boolean")
    appeals = spark.createDataFrame([(1, 1, 7, "open"), (2, 2, 7, "open"), (3, 3, 8, "open"), (4, 3, 8, "rejected")], "id int, message_id int, user_id int, status string")
    decisions = spark.createDataFrame([(1, "accepted", "n"), (2, "accepted", "n"), (3, "rejected", "n"), (4, "accepted", "n")], "appeal_id int, decision string, note string")
    new_appeals, new_logs, new_users = service.appeal_effects(appeals, decisions, logs, users)
    assert {r["id"]: r["status"] for r in new_appeals.collect()} == {1: "accepted", 2: "accepted", 3: "rejected", 4: "rejected"}
    assert {r["id"]: (r["is_toxic"], r["action_taken"]) for r in new_logs.collect()} == {1: (False, "passed"), 2: (False, "passed"), 3: (True, "warned")}
    assert {r["id"]: (r["warning_count"], r["is_banned"]) for r in new_users.collect()} == {7: (0, False), 8: (3, True), 9: (1, True)}
    reset = service.reset_users(users, spark.createDataFrame([(8,), (99,)], "user_id int"))
    assert {r["id"]: (r["warning_count"], r["is_banned"]) for r in reset.collect()} == {7: (0, True), 8: (0, False), 9: (1, True)}


def test_health_needs_a_model_only_where_asked():
    assert moderation.health("no manifest", None)["available"] and not moderation.health("no manifest", None, allow_rules_only=False)["available"]
    assert moderation.model_problem(None) == "no manifest"
