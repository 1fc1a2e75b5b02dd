"""A repository run over real files: binaries, failures, products read back, command line, settings."""

import dataclasses
import http.server
import json
import pathlib
import re
import threading
import time
import types

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import cipherlode
from cipherlode import cli, rules, runtime
from cipherlode.functions import classify as C
from cipherlode.operators import enrich, labels, providers, scan
from cipherlode.plans import repository
from cipherlode.settings import Settings
from cipherlode.sources import corpus, files, github, reader, sinks
from cipherlode.sources.github import FetchError, GitHubRepository

JAVA = 'import javax.crypto.Cipher;\nclass A { Object d = MessageDigest.getInstance("MD5"); }\n'


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repos") / "repo"
    (top / "src").mkdir(parents=True)
    (top / "src/a.py").write_text("x = hashlib.md5(b'')\nk = rsa.generate_private_key(65537)\n")
    (top / "src/A.java").write_text(JAVA)
    (top / "src/latin.c").write_bytes(b"// gr\xfc\xdfe\n" + b"// filler\n" * 900 + b"SSL_library_init();\n")
    (top / "src/lib.go").write_bytes(corpus.elf_file(["libcrypto.so.3"], ["AES_encrypt", "main"]))
    (top / "src/win.h").write_bytes(corpus.pe_file({"bcrypt.dll": ["BCryptFoo", "Other"]}, ["NCryptX"]))
    (top / "src/bad.cpp").write_bytes(b"MZ" + bytes(80))
    (top / "src/empty.ts").write_text("")
    (top / "build").mkdir()
    (top / "build/no.py").write_text("hashlib.md5(x)")
    return str(top)


@pytest.fixture(scope="module")
def run(spark, root):
    return repository.analyse(files.read_repository(spark, root, files.scan_profile("default-source")))


def test_every_file_is_read_as_what_it_is(run):
    got = {r.path: (r.file_type, r.target_type) for r in run.files.collect()}
    assert got == {"src/a.py": ("TEXT", "source-code"), "src/A.java": ("TEXT", "source-code"), "src/latin.c": ("BINARY", "source-code"), "src/lib.go": ("ELF", "binary"), "src/win.h": ("PE", "binary"), "src/bad.cpp": ("PE", "binary"), "src/empty.ts": ("TEXT", "source-code")}
    assert [(r.file, r.error) for r in run.failures.collect()] == [("src/bad.cpp", "no PE header")]


def test_assets_of_texts_and_binaries(run):
    got = {(r.path, r.algorithm, r.source, r.confidence, tuple(r.locations)) for r in run.assets.collect()}
    assert {("src/lib.go", "AES", "binary", 0.95, ()), ("src/win.h", "generic-cipher", "binary", 0.65, ()), ("src/win.h", "generic-asymmetric", "binary", 0.65, ()), ("src/a.py", "RSA", "source-code", 0.95, ("Line 2",)), ("src/a.py", "MD5", "source-code", 0.95, ("Line 1",))} <= got
    evidence = {(r.path, r.algorithm): r.evidence for r in run.labels.collect()}
    one = evidence["src/win.h", "generic-cipher"][0]
    assert (one.detector, one.snippet, one.source_type, one.line_start) == ("pe_import", "bcrypt.dll!BCryptFoo", "binary", None)
    assert evidence["src/win.h", "generic-asymmetric"][0].detector == "pe_export"
    layers = {(r.path, r.algorithm): r.layer for r in run.assets.collect()}
    assert layers["src/A.java", "generic-cipher"] == "context_crypto" and layers["src/A.java", "MD5"] == "confirmed_crypto"
    assert [(r.path, r.name) for r in run.libraries.orderBy("name").collect()] == [("src/win.h", "bcrypt.dll"), ("src/lib.go", "libcrypto.so.3")]


def test_report(run):
    got = {r.path: r for r in repository.report(run).collect()}
    a = got["src/a.py"]
    assert (a.total_crypto_components, a.pqc_ready, a.not_pqc_ready, a.algorithm_names, a.target_type) == (2, 0, 2, ["MD5", "RSA"], "source-code")
    assert [(x.algorithm, x.current_risk) for x in a.high_priority] == [("MD5", 66.5)] and [x.algorithm for x in a.medium_priority] == ["RSA"] and a.average_risk == 63.0


def test_products(spark, root, tmp_path):
    work = runtime.work_folder(spark).removeprefix("file://")
    before = {str(p) for p in pathlib.Path(work).iterdir()}
    summary = repository.write_run(spark, root, files.scan_profile("default-source"), str(tmp_path))
    assert (summary["files_selected"], summary["failures"]) == (7, 1) and re.search(r"/run_\d{8}_\d{6}_repo-default-source$", summary["output_dir"])
    out = summary["outputs"]
    assert set(out) == {"cbom_json", "cbom_confirmed_json", "cbom_context_json", "labeled_json", "training_jsonl", "review_jsonl", "policy_drop_jsonl", "quality_reject_jsonl", "dropped_jsonl", "failures_jsonl"}
    whole, sure, context = (json.loads(sinks.read_document(spark, out[k])) for k in ("cbom_json", "cbom_confirmed_json", "cbom_context_json"))
    n = summary["assets_total"]
    assert len(whole["crypto_assets"]) == whole["summary"]["total_algorithms"] == n == len(sure["crypto_assets"]) + len(context["crypto_assets"])
    assert whole["metadata"]["layers"] == {"confirmed_crypto_assets": n - 1, "context_crypto_assets": 1} and context["crypto_assets"][0]["layer"] == "context_crypto"
    assert len(json.loads(sinks.read_document(spark, out["labeled_json"]))) == n
    counts = {k: spark.read.text(out[f"{k}_jsonl"]).count() for k in ("training", "review", "policy_drop", "quality_reject", "dropped")}
    assert counts == {k: summary[k] for k in counts} and counts["dropped"] == counts["policy_drop"] + counts["quality_reject"]
    written = json.loads(sinks.read_document(spark, f"{summary['output_dir']}/repo_batch_summary.json"))
    assert written["assets_total"] == n and written["outputs"] == out
    assert {str(p) for p in pathlib.Path(work).iterdir()} == before  # what the run has stored meanwhile is gone


def test_report_and_table_files(spark, run, tmp_path):
    repository.write_report(run, str(tmp_path / "report"))
    assert {r["path"] for r in json.loads(sinks.read_document(spark, str(tmp_path / "report")))} == {r.path for r in run.assets.select("path").distinct().collect()}
    sinks.write_asset_csv(run.assets, str(tmp_path / "csv"))
    lines = sinks.read_document(spark, str(tmp_path / "csv")).split("\n")
    assert lines[0] == "Algoritma,Tür,Anahtar Uzunluğu,PQC,Risk Skoru,Seviye" and "MD5,hash,N/A,False,66.5,high" in lines and len(lines) == run.assets.count() + 1
    sinks.write_json_array(run.labels.limit(0), str(tmp_path / "none"))
    assert json.loads(sinks.read_document(spark, str(tmp_path / "none"))) == []


def test_a_run_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none/readme.txt").write_text("x")
    summary = repository.write_run(spark, str(tmp_path / "none"), files.scan_profile("default-source"), str(tmp_path / "out"))
    assert (summary["files_selected"], summary["assets_total"], summary["outputs"]) == (0, 0, {})


def test_enrichment(spark, root):
    asked = []
    how = repository.Enrichment(min_confidence=1.0, max_snippets=1, provider=lambda texts: [{"success": True, "algorithm": "Falcon" if t.startswith("Binary file") else "MD5", "key_length": 77, "is_pqc_safe": t.startswith("Binary"), "confidence": 0.99} for t in texts])
    got = {(r.path, r.algorithm): r for r in repository.analyse(files.read_repository(spark, root, files.scan_profile("default-source")), how).assets.collect()}
    assert (got["src/lib.go", "Falcon"].confidence, got["src/lib.go", "Falcon"].key_length, got["src/lib.go", "Falcon"].source) == (0.99, 77, "binary-llm")
    assert got["src/lib.go", "AES"].confidence == 0.95 and got["src/lib.go", "AES"].source == "binary" and got["src/A.java", "MD5"].confidence == 0.99 and got["src/A.java", "MD5"].key_length == 77
    assert not any(path in ("src/latin.c", "src/bad.cpp") for path, _ in got) and not asked


def test_binaries_without_known_names_are_not_asked_about(spark):
    """No asset from nothing: an unknown binary, one whose symbols no table knows, one with a library only, one with both."""
    rows = [("1", "a/blob.bin", b"\xff\xfe\x00"), ("2", "a/plain.so", corpus.elf_file([], ["main", "printf"])), ("3", "b/lib.so", corpus.elf_file(["libz.so", "liba.so", "libz.so"], ["main"])), ("4", "b/both.so", corpus.elf_file(["libm.so"], ["SHA256", "main", "AES_encrypt", "SHA256"]))]
    df = spark.createDataFrame(rows, "file_id string, path string, content binary")
    run = repository.analyse(df, repository.Enrichment(provider=lambda texts: [{"success": True, "algorithm": t, "confidence": 0.5} for t in texts]))
    got = {(r.path, r.algorithm): r.source for r in run.assets.collect()}
    assert got == {
        ("b/lib.so", "Binary file: lib.so\nDetected libraries: libz.so, liba.so\nDetected symbol names:\nnone"): "binary-llm",
        ("b/both.so", "Binary file: both.so\nDetected libraries: libm.so\nDetected symbol names:\nSHA256, AES_encrypt"): "binary-llm", ("b/both.so", "SHA-256"): "binary", ("b/both.so", "AES"): "binary",
    }
    mocked = repository.analyse(df, repository.Enrichment()).assets
    assert {r.path for r in mocked.collect()} == {"b/lib.so", "b/both.so"}


def test_a_provider_that_fails():
    def provider(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [{"success": True, "algorithm": t} for t in texts]

    got = enrich.asked(provider, ["a", " ", "bad", "b"])
    assert [r["success"] for r in got] == [True, False, False, True] and got[2]["error"] == "ValueError: no" and got[1]["error"] == "empty snippet"


class Model(http.server.BaseHTTPRequestHandler):
    """A server like the providers': refuses a first call for some texts, is slow, wrong or broken for others."""

    calls: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = json.dumps(body)
        again = text in Model.calls
        Model.calls.append(text)
        if "slow" in text:
            time.sleep(1.5)
        code = 429 if "busy" in text and not again else 400 if "refused" in text else 200
        reply = "no idea" if "vague" in text else 'Sure: {"algorithm": "RSA", "key_length": 2048, "mode": null, "is_pqc_safe": false, "confidence": 0.8} there'
        if self.path == "/chat/completions":
            assert self.headers["Authorization"] == "Bearer k" and body["max_tokens"] == 7 and body["temperature"] == 0.1
            answer = {"choices": [{"message": {"content": reply}}]}
        else:
            answer = {"response": reply} if self.path == "/api/generate" else [{"generated_text": reply}]
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0")
        self.end_headers()
        try:
            self.wfile.write(json.dumps(answer).encode())
        except BrokenPipeError:
            pass

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    one = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_address[1]}"
    one.shutdown()


@pytest.mark.parametrize("name", ["openai", "huggingface", "ollama"])
def test_providers_ask_a_server(spark, server, name):
    Model.calls.clear()
    ask = providers.provider(Settings(name, True, "k", server, "m", temperature=0.1, max_tokens=7, timeout=1))
    ask = dataclasses.replace(ask, pause=0.0)
    texts = ["plain one", "busy one", "refused one", "vague one", "slow one", "plain one", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, snippet string")
    got = {r.i: r.r for r in enrich.analyse(df, ask, tasks=2).collect()}
    assert [got[i].success if got[i] else None for i in range(8)] == [True, True, False, False, False, True, False, None]
    assert (got[0].algorithm, got[0].key_length, got[0].mode, got[0].confidence) == ("RSA", 2048, None, 0.8)
    assert "400" in got[2].error and "JSON" in got[3].error and name in got[4].error and got[6].error == "empty snippet"
    counts = {w: sum(w in c for c in Model.calls) for w in ("plain", "busy", "refused", "slow")}
    assert counts == {"plain": 1, "busy": 2, "refused": 1, "slow": 3}


def test_rate():
    rate, began = providers.Rate(50), time.monotonic()
    for _ in range(11):
        rate.wait()
    assert 0.19 < time.monotonic() - began < 2


def test_answers_are_kept_between_runs(spark, server, tmp_path):
    Model.calls.clear()
    cache = str(tmp_path / "answers")
    ask = dataclasses.replace(providers.provider(Settings("ollama", True, None, server, "m", timeout=5)), pause=0.0)
    df = spark.createDataFrame([(i, f"text {i % 6}" if i % 4 else "refused") for i in range(12)], "i int, snippet string")
    first = sorted((r.i, r.r.success) for r in enrich.analyse(df, ask, cache).collect())
    asked = len(Model.calls)
    assert asked == len({f"text {i % 6}" for i in range(12) if i % 4}) + 1 and dict(first)[0] is False and dict(first)[1]
    assert sorted((r.i, r.r.success) for r in enrich.analyse(df, ask, cache).collect()) == first and len(Model.calls) == asked + 1  # the refused one
    assert enrich.analyse(df.where("i % 4 > 0"), ask, cache).where("r.success").count() == 9 and len(Model.calls) == asked + 1
    other = dataclasses.replace(ask, model="other")
    enrich.analyse(df.where("i = 1"), other, cache).collect()
    assert len(Model.calls) == asked + 2


def test_unusable_providers_are_refused(root, tmp_path, monkeypatch, capsys):
    for name, said in (("openai", "key"), ("huggingface", "key"), ("other", "no provider")):
        monkeypatch.setenv("LLM_PROVIDER", name)
        assert cli.main(["repo", root, "--use-llm", "--output-dir", str(tmp_path)]) == 2 and said in capsys.readouterr().err
    assert not list(tmp_path.iterdir())
    assert providers.provider(Settings()) is None
    providers.register("own", lambda settings: lambda texts: [{"success": True, "algorithm": settings.model}] * len(texts))
    assert providers.provider(Settings("own", model="x"))(["t"]) == [{"success": True, "algorithm": "x"}]


def test_command_line(spark, root, tmp_path, capsys):
    assert cli.main(["repo", root, "--profile", "default-source", "--output-dir", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["files_selected"] == 7
    assert cli.main(["file", f"{root}/src/a.py"]) == 0
    assert json.loads(capsys.readouterr().out)["algorithm_names"] == ["MD5", "RSA"]
    (tmp_path / "rules.json").write_text(json.dumps({"table": "pattern", "ord": 0, "rule": r"\bfiller\b", "algorithm": "Filler", "primitive": "none", "confidence": 0.9}))
    assert cli.main(["repo", root, "--profile", "default-source", "--output-dir", str(tmp_path / "own"), "--rules", str(tmp_path / "rules.json")]) == 0
    bom = json.loads(sinks.read_document(spark, json.loads(capsys.readouterr().out)["outputs"]["cbom_json"]))
    assert {a["algorithm"] for a in bom["crypto_assets"] if a["source"] == "source-code"} <= {"Filler", "MD5", "generic-cipher"}
    assert cli.main(["file", f"{root}/src/empty.ts"]) == 0
    assert json.loads(capsys.readouterr().out)["total_crypto_components"] == 0
    assert cli.main(["file", f"{root}/src/none.ts"]) == 2 and cli.main(["repo", root, "--profile", "none"]) == 2
    for wrong in ([], ["repo"], ["file"]):
        with pytest.raises(SystemExit):
            cli.arguments(wrong)


def test_switches_of_texts_and_binaries(spark, root, monkeypatch, tmp_path, capsys):
    df = files.read_repository(spark, root, files.scan_profile("default-source"))
    assert {r.target_type for r in repository.report(repository.analyse(df, texts=False)).collect()} == {"binary"}
    only = repository.analyse(df, repository.Enrichment(), binaries=False)
    assert {r.source for r in only.assets.collect()} == {"source-code"} and only.failures.count() == 0
    monkeypatch.setenv("ENABLE_SOURCE_CODE_ANALYSIS", "false")
    assert cli.main(["file", f"{root}/src/a.py"]) == 0 and json.loads(capsys.readouterr().out)["total_crypto_components"] == 0


def test_fetching_a_repository(spark, tmp_path, monkeypatch):
    asked = []

    def git(command, env, **_):
        asked.append((command[3:], env))
        if command[3] == "checkout":
            top = pathlib.Path(command[2])
            (top / ".git").mkdir()
            (top / ".git/config").write_text("x")
            (top / "src").mkdir()
            (top / "src/a.py").write_text("hashlib.md5(x)\n")
            (top / "b.py").write_text("pass\n")
        return types.SimpleNamespace(returncode=0, stderr="")

    one = GitHubRepository.at("https://github.com/a/b/", " main ", 0, "secret")
    with one.fetched(spark, run=git) as folder:
        assert {p.name for p in pathlib.Path(folder).iterdir()} == {".git", "src", "b.py"}
    assert not pathlib.Path(folder).exists()
    assert [c[0] for c, _ in asked] == ["init", "fetch", "checkout"] and asked[1][0][-3:] == ["--depth=1", "https://github.com/a/b", "main"]
    assert "secret" not in str([c for c, _ in asked]) and asked[1][1]["GIT_CONFIG_VALUE_0"].startswith("Authorization: Basic ")
    assert "GIT_CONFIG_COUNT" not in GitHubRepository.at("https://GitHub.com/a/b", token="").credentials()
    with pytest.raises(FetchError, match="a/b: git init: fatal"):
        one.fetch(str(tmp_path), lambda *_, **__: types.SimpleNamespace(returncode=128, stderr="fatal: no"))
    for wrong in ("http://github.com/a/b", "https://example.org/a/b", "https://github.com/a", "https://github.com.evil.org/a/b"):
        with pytest.raises(ValueError):
            GitHubRepository.at(wrong)
    # on a cluster the files go to the work folder that executors share
    monkeypatch.setattr(github, "work_folder", lambda _: f"file://{tmp_path}/shared")
    cluster = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://host:7077", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc))
    with one.fetched(cluster, run=git) as shared:
        assert shared.startswith(f"file://{tmp_path}/shared/")
        got = files.read_repository(spark, shared, {"include_globs": ["**/*"], "exclude_globs": [], "max_files": 9}).collect()
        assert [(r.path, r.content) for r in got] == [("b.py", b"pass\n"), ("src/a.py", b"hashlib.md5(x)\n")]
    assert not pathlib.Path(shared.removeprefix("file://")).exists()


def test_settings():
    assert Settings.from_environment({}) == Settings()
    s = Settings.from_environment({"LLM_PROVIDER": "openai", "USE_LLM": "TRUE", "OPENAI_API_KEY": "k", "OPENAI_MAX_TOKENS": "7", "OPENAI_TEMPERATURE": "0.5", "API_TIMEOUT": "9", "LLM_CALLS_PER_SECOND": "2"})
    one = providers.provider(s)
    assert s.use_llm and (one.base_url, one.model, one.api_key, one.max_tokens, one.temperature, one.timeout, one.rate) == ("https://api.openai.com/v1", "gpt-3.5-turbo", "k", 7, 0.5, 9, 2.0)
    assert providers.provider(Settings.from_environment({"LLM_PROVIDER": "ollama"})).base_url == "http://localhost:11434"
    assert not Settings.from_environment({"ENABLE_BINARY_ANALYSIS": "false"}).binaries


EVERY = {"include_globs": ["**/*.py"], "exclude_globs": ["**/node_modules/**", "**/*.min.py"], "max_files": 100}


def test_files_left_out_are_never_opened(spark, tmp_path, monkeypatch):
    for name, text in (("src/a.py", "x" * 10), ("src/B.py", "y" * 5000), ("src/b.PY", ""), ("node_modules/z.py", "z" * 9000), (".git/h.py", "h"), ("src/c.min.py", "m"), ("src/c.txt", "t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    opened = []

    class Local:
        def __init__(self):
            self.fs = fs.LocalFileSystem()

        def get_file_info(self, selector):
            opened.append(("list", selector.base_dir.removeprefix(f"{tmp_path}")))
            return self.fs.get_file_info(selector)

        def open_input_stream(self, path):
            opened.append(("open", path.removeprefix(f"{tmp_path}/")))
            return self.fs.open_input_stream(path)

    monkeypatch.setattr(reader, "opened", lambda root: (Local(), root))
    r = reader.RepositoryReader(str(tmp_path), EVERY, 1000)
    parts = r.partitions()
    assert [f.path for p in parts for f in p.files] == [".git/h.py", "src/B.py", "src/a.py"] and {x for k, x in opened if k == "list"} == {"", "/src", "/.git"}
    rows = [x for p in parts for batch in r.read(p) for x in batch.to_pylist()]
    assert [x for k, x in opened if k == "open"] == [".git/h.py", "src/B.py", "src/a.py"]
    assert [(x["path"], x["content"], x["length"], x["error"]) for x in rows] == [(".git/h.py", b"h", 1, None), ("src/B.py", None, 5000, "longer than 1000 bytes"), ("src/a.py", b"x" * 10, 10, None)]


def test_what_cannot_be_read_is_a_failure(spark, tmp_path):
    """A file with a read error, one that went after it was listed, one that became a folder, one that is too long; the run ends well."""
    top = tmp_path / "repo"
    top.mkdir()
    (top / "good.py").write_text("hashlib.md5(b)\n")
    (top / "long.py").write_text("# " + "x" * 3000)
    (top / "link.py").symlink_to("/proc/self/mem")  # its first byte gives an error
    (top / "nowhere.py").symlink_to(tmp_path / "nothing")  # no file at all
    for name in ("gone.py", "folder.py"):
        (top / name).write_text("pass")
    r = reader.RepositoryReader(str(top), EVERY, 1000)
    parts = r.partitions()
    (top / "gone.py").unlink()
    (top / "folder.py").unlink()
    (top / "folder.py").mkdir()
    rows = {x["path"]: x for p in parts for batch in r.read(p) for x in batch.to_pylist()}
    assert {p for p, x in rows.items() if x["content"] is None and x["error"]} == {"gone.py", "folder.py", "link.py", "long.py"} and rows["good.py"]["content"]
    assert "FileNotFoundError" in rows["gone.py"]["error"]
    summary = repository.write_run(spark, str(top), EVERY | {"name": "own"}, str(tmp_path / "out"), max_bytes=1000)
    assert (summary["files_selected"], summary["failures"], summary["assets_total"]) == (3, 2, 1)
    assert {json.loads(r.value)["file"] for r in spark.read.text(summary["outputs"]["failures_jsonl"]).collect()} == {"link.py", "long.py"}


def test_files_are_dealt_by_size(monkeypatch):
    monkeypatch.setattr(reader, "PARTITION_FILES", 3)
    files = [reader.Found(f"{i:02}", 20 << 20 if i % 5 == 0 else None if i == 7 else 10) for i in range(12)]
    parts = reader.dealt(files)
    assert [f for p in parts for f in p.files] == files and all(len(p.files) <= 3 for p in parts) and max(sum(f.length or 0 for f in p.files) for p in parts) <= 32 << 20
    assert len(reader.dealt([])) == 1


def test_one_pass_of_sets(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None), (5, ["other"])], "i int, s array<string>")
    paths = {k: str(tmp_path / k) for k in ("a", "b", "c")}
    assert sinks.write_sets(df, "s", paths) == {"a": 2, "b": 1, "c": 0}
    assert {k: sorted(json.loads(r.value)["i"] for r in spark.read.text(p).collect()) for k, p in paths.items()} == {"a": [1, 2], "b": [1], "c": []}
    assert spark.read.text(paths["b"]).first().value == '{"i":1}' and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]
    assert sinks.write_jsonl(df.select("i"), str(tmp_path / "l")) == 5


def test_profile_names_and_merging(spark, tmp_path):
    assert files.profile_names() == ["default-source", "fineract-java", "quickfix-cpp"] and files.profile_names(str(tmp_path / "none.json")) == []
    a, b = {"x": {"y": 1, "z": 2}, "w": 1}, {"x": {"y": 3}, "w": 2, "v": 4}
    assert files.merged(a, b) == {"x": {"y": 3, "z": 2}, "w": 2, "v": 4} and files.merged(a, b, False) == {"x": {"y": 1, "z": 2}, "w": 1, "v": 4}
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "a map<string,string>, b map<string,string>")
    r = df.select(C.merged_maps(F.col("a"), F.col("b")).alias("x"), C.merged_maps(F.col("a"), F.col("b"), False).alias("y")).first()
    assert r.x == {"a": "1", "b": "3"} and r.y == {"a": "1", "b": "2"}


def test_policy_file_with_its_own_issues(spark, tmp_path):
    spec = {"issue_policies": {"UNKNOWN_CATEGORY": {"severity": "high", "action": "drop"}}, "penalties": {"high": 1.0, "medium": 1.0, "low": 1.0}, "quality_weights": rules.POLICY_VALUES["weights"], "quality_tiers": rules.POLICY_VALUES["tiers"], "global": rules.POLICY_VALUES["limits"]}
    (tmp_path / "p.json").write_text(json.dumps(spec))
    df = spark.createDataFrame([("Strange", None, None, None, 0.9, 1), ("RSA", None, "CBC", None, 0.9, 1)], "algorithm string, key_length int, mode string, padding string, confidence double, evidence_count int")
    got = {r.algorithm: r for r in labels.label(df, files.policy(str(tmp_path / "p.json"))).collect()}
    assert (got["Strange"].split, got["Strange"].max_severity, got["Strange"].severity_penalty) == ("policy_drop", "high", 1.0)
    assert (got["RSA"].final_action, got["RSA"].max_severity) == ("require_review", "medium")  # as of an unlisted issue


def test_filters(run):
    n = run.labels.count()
    assert labels.with_tier(run.labels, []).count() == n and labels.with_severity(run.labels, []).count() == 0
    assert labels.training_only(run.labels).count() == run.labels.where("split = 'training'").count()
    assert labels.first_evidence(run.labels, 1).count() == n


def test_exports():
    assert cipherlode.scan_text is scan.scan_text and cipherlode.analyse is repository.analyse and all(getattr(cipherlode, n) for n in cipherlode.__all__)
    with pytest.raises(AttributeError):
        cipherlode.nothing  # noqa: B018


def test_scanning_a_large_file_equals_plain_search(spark):
    """A megabyte of calls: every line and count as by a plain search, in time that follows from the length."""
    import time

    line = "int r = AES_encrypt(in, out, &key); RAND_seed(buf, n); hashlib.md5 (x);\n"
    times = {}
    for n in (1, 14_000, 28_000):
        text = line * n
        df = spark.createDataFrame([(1, "a.c", text)], "file_id long, path string, content string")
        scan.scan_text(df).count()  # compiled
        began = time.time()
        got = sorted((r.name, r.line) for r in scan.scan_text(df).select("name", "line").collect())
        times[n] = time.time() - began
        want = set()
        for rx, algorithm, _, _ in rules.PATTERNS:
            want |= {(algorithm, k) for k in range(1, n + 1)} if re.search(rx, line, re.I) else set()
        want |= {(name, k) for name, *_ in rules.CALLS if re.search(rf"\b{name}\s*\(", line, re.I) for k in range(1, n + 1)}
        assert got == sorted(want)
    assert times[14_000] < 10 + times[1] and times[28_000] < 4 * times[14_000] + 5
