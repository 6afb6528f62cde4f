"""Provider readers on literal logs, and the inbox stream."""

import io
import json
import zipfile
from datetime import datetime

import pytest

from threadloom.sources import elements, providers
from threadloom.store import Store
from threadloom.streaming import inbox


def parsed(reader, value, path="/x/sessions/log-12345678.jsonl"):
    raw = value if isinstance(value, bytes) else ("\n".join(json.dumps(v) for v in value) if isinstance(value, list) and path.endswith("jsonl") else json.dumps(value)).encode()
    out = providers.Found()
    out.attempt("file", providers.READERS[reader], path, raw)
    return out


def test_chatgpt_tree_and_zip():
    node = lambda parent, text=None, role="user", **meta: {"parent": parent, "message": None if text is None else {"author": {"role": role}, "create_time": 1700000000, "content": {"parts": [text]}, "metadata": meta}}
    conv = {"id": "c", "title": "T", "create_time": 1700000000, "update_time": "2024-01-01T00:00:00Z", "mapping": {"root": node(None), "a": node("root", " hi "), "gap": node("a"), "b": node("gap", "yo", "assistant"), "t": node("b", "", "tool", args={"q": 1}), "e": node("t", "")}}
    for raw in (json.dumps([conv, 7]).encode(),):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            z.writestr("conversations.json", raw)
        for data in (raw, packed.getvalue()):
            out = parsed("chatgpt", data, "/x/chatgpt.json")
            m = out.rows["messages"]
            assert [(r["content"], r["role"]) for r in m] == [("hi", "user"), ("yo", "assistant"), ("", "tool")]
            assert m[0]["parent_id"] is None and m[1]["parent_id"] == m[0]["id"] and m[2]["parent_id"] == m[1]["id"]
            assert out.rows["tool_calls"][0]["input"] == '{"q": 1}' and len(out.errors) == 1
            assert out.rows["conversations"][0]["created_at"] == datetime(2023, 11, 14, 22, 13, 20)


def test_claude_export():
    out = parsed("claude", [{"uuid": "u", "name": "N", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [{"uuid": "m", "sender": "human", "text": "hey", "attachments": [{"file_name": "f.txt", "file_size": 3}]}, {"id": "n", "sender": "assistant", "content": [{"type": "text", "text": "yo"}, {"type": "thinking", "thinking": "hm"}]}, {"uuid": "o", "text": ""}]}], "/x/claude.json")
    assert [(r["content"], r["thinking"]) for r in out.rows["messages"]] == [("hey", None), ("yo", "hm")] and out.rows["attachments"][0]["filename"] == "f.txt"


def test_claude_code_threads_tools_and_edits():
    log = [
        {"type": "system", "cwd": "/r", "gitBranch": "main", "timestamp": "2024-01-01T00:00:00Z"},
        {"type": "user", "uuid": "1", "timestamp": "2024-01-01T00:01:00Z", "message": {"content": "do it"}},
        {"type": "assistant", "uuid": "2", "parentUuid": "1", "timestamp": "2024-01-01T00:02:00Z", "message": {"content": [{"type": "tool_use", "id": "t", "name": "Edit", "input": {"file_path": "/r/a", "old_string": "x", "new_string": "y"}}]}},
        {"type": "user", "uuid": "3", "parentUuid": "1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": "done"}]}},
    ]
    out = parsed("claude-code", log, "/p/-Users-me-r/abcdefghij.jsonl")
    ids = [r["id"] for r in out.rows["messages"]]
    assert [r["parent_id"] for r in out.rows["messages"]] == [None, ids[0], ids[0]] and out.rows["messages"][1]["content"] == ""
    assert [(r["tool_name"], r["status"]) for r in out.rows["tool_calls"]] == [("Edit", "pending"), ("t", "complete")]
    e = out.rows["file_edits"][0]
    assert (e["file_path"], e["edit_type"], e["content"], e["old_content"], e["message_id"]) == ("/r/a", "edit", "y", "x", ids[1])
    c = out.rows["conversations"][0]
    assert c["title"] == "~/me/r (abcdefgh)" and c["cwd"] == "/r" and c["updated_at"] == datetime(2024, 1, 1, 0, 2)
    assert not parsed("claude-code", [{"type": "system"}]).rows["conversations"]


def test_codex_anchors_patches_and_failures():
    item = lambda **p: {"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": p}
    patch = "*** Begin Patch\n*** Update File: a.py\n@@\n keep\n-old\n+new\n*** Add File: b.py\n+one\n*** Delete File: c.py\n*** End Patch"
    log = [
        {"type": "session_meta", "payload": {"cwd": "/r", "model_provider": "m"}},
        item(type="function_call", name="shell", arguments=json.dumps({"command": ["cat", "<<'EOF'", ">", "x.txt\nbody\nEOF"]})),
        item(type="message", role="developer", content=[{"type": "input_text", "text": "rules"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "go"}, {"type": "input_image", "image_url": "data:image/png;base64,QUJD"}]),
        item(type="function_call", name="exec_command", arguments={"cmd": patch}),
        item(type="function_call_output", call_id="k", output="ok"),
        item(type="custom_tool_call", name="apply_patch", call_id="good", input=patch), item(type="custom_tool_call_output", call_id="good", output="Success. Updated"),
        item(type="custom_tool_call", name="apply_patch", call_id="bad", input=patch), item(type="custom_tool_call_output", call_id="bad", output="verification failed"),
    ]
    out = parsed("codex", log)
    m = out.rows["messages"]
    assert len(m) == 1 and {r["message_id"] for r in out.rows["tool_calls"]} == {m[0]["id"]} and out.rows["attachments"][0]["size"] == 3
    assert [r["status"] for r in out.rows["tool_calls"]] == ["pending", "pending", "complete", "complete", "failed"]
    edits = [(r["file_path"], r["edit_type"], r["content"], r["old_content"]) for r in out.rows["file_edits"]]
    assert edits[0] == ("/r/x.txt", "write", "body", None)
    assert edits[1:4] == [("/r/a.py", "edit", "keep\nnew", "keep\nold"), ("/r/b.py", "write", "one", None), ("/r/c.py", "delete", "", None)] and len(edits) == 7
    assert providers.edit_logs.of_command("echo hi > out.log") == [("out.log", "shell", "echo hi > out.log", None)] and providers.edit_logs.of_command("ls > /dev/null") == []


def test_commands_and_scripts():
    of = providers.edit_logs.of_command
    assert of("cat <<'EOF' > a/b.txt\none\ntwo\nEOF", "/r") == [("/r/a/b.txt", "write", "one\ntwo", None)]
    assert of("tee -a notes.md <<-END\nx\nEND\n") == [("notes.md", "write", "x", None)]
    assert of("make 2> err.log") == of("make &> all.log") == of("sort > 'my file.txt'") == of("") == of(None) == []
    assert of("ls > /dev/null > out.txt")[0][0] == "out.txt" and of("x >> a.tar.gz2")[0][0] == "a.tar"
    patch = "*** Begin Patch\n*** Add File: n\n+1\n*** End Patch"
    code = f"const p = {json.dumps(patch)}; await tools.apply_patch(p); await tools.apply_patch( {json.dumps(patch + 'x')} ); await tools.apply_patch(q); await tools.other(p)"
    assert providers.edit_logs.of_script(code) == [patch, patch + "x"]


def test_custom_calls_blocks_and_line_ends():
    item = lambda **p: {"type": "response_item", "payload": p}
    out = parsed("codex", [item(type="custom_tool_call", name="x", call_id="a"), item(type="message", role="user", content=[{"type": "text", "text": "go"}, {"type": "input_image", "image_url": "data:image/jpeg;base64,QUJD"}, {"type": "input_image", "image_url": "https://e/x"}]), item(type="custom_tool_call", name="y", call_id="b", status="completed")])
    assert [(r["status"], r["message_id"]) for r in out.rows["tool_calls"]] == [(s, out.rows["messages"][0]["id"]) for s in ("pending", "complete")]
    assert [r["filename"] for r in out.rows["attachments"]] == ["image-1.jpg", "image-2.bin"]
    found = providers.blocks(["loose", {"type": "file", "name": "f", "size": 3, "url": "u"}, {"content_type": "image_asset_pointer", "asset_pointer": "p"}, {"type": "thinking", "thinking": "hm"}])
    assert found["text"] == "loose" and found["thinking"] == "hm" and [(f["filename"], f["url"]) for f in found["files"]] == [("f", "u"), (None, "p")]
    out = parsed("claude-code", '{"type":"user","message":{"content":"a\u2028b"}}\n{"type":"user","message":{"content":"c"}}'.encode())
    assert [r["content"] for r in out.rows["messages"]] == ["a\u2028b", "c"] and not out.errors
    tree = {"a": {"parent": "b", "message": 1}, "b": {"parent": "c"}, "c": {"parent": "b"}, "d": {"parent": "e"}, "e": {"parent": "a"}, "f": {"parent": "gone", "message": 1}}
    assert providers.spoken_ancestors(tree) == {"a": None, "b": None, "c": None, "d": "a", "e": "a", "f": None}


def test_broken_lines_and_ids():
    out = parsed("claude-code", b'{"type":"user","message":{"content":"a"}}\n\nnot json\n[1]\n{"type":"user","message":{"content":"b"}}')
    assert [r["content"] for r in out.rows["messages"]] == ["a", "b"] and len(out.errors) == 2
    assert len(providers.gen_id("a", "b")) == 16 and providers.moment("x") is None and providers.moment("") is None


@pytest.mark.parametrize("split", [512, 1 << 27])
def test_lists_are_read_by_their_elements(spark, tmp_path, split):
    odd = ['plain', 'a } b', '{"x": [1, {"y": "}"}]}', 'back \\\\" slash \\', "line\nfeed\r\n", "], [", "é\u2028ü", ""]
    wanted = {f"f{k}.json": [{"id": f"{k}-{i}", "text": text * (i % 3), "nested": {"l": [{"t": text}, [], {}]}} for i, text in enumerate(odd * 3)] for k in range(3)}
    for k, (name, rows) in enumerate(wanted.items()):
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if k == 2 else b"") + json.dumps(rows, indent=[None, 1, "\t"][k], ensure_ascii=k == 1).encode())
    for name, text in {"none.json": "[ ]\n", "empty.json": "", "object.json": '{"a": {"b": 1}}', "broken.json": '[{"id": 1}, {"id": 2', "number.json": '[{"id": 3}, 7]', "other.txt": '[{"id": 4}]'}.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0 if split == 512 else 4 << 20)
    try:
        found, faults = elements.elements(spark, str(tmp_path))
        rows, told = found.collect(), faults.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, own in wanted.items():
        mine = sorted((r for r in rows if r["path"].endswith("/" + name)), key=lambda r: r["at"])
        assert [json.loads(r["element"]) for r in mine] == own
    others = sorted(r["element"] for r in rows if r["path"].rpartition("/")[2] not in wanted)
    assert others == ['{"id": 1}', '{"id": 3}']
    assert sorted((r["path"].rpartition("/")[2], r["error"][:5]) for r in told) == [("broken.json", "no wh"), ("number.json", "no wh"), ("object.json", "not a")]


def test_exports_and_image_bodies_in_the_store(spark, tmp_path):
    logs = tmp_path / "sessions"
    logs.mkdir()
    node = {"parent": None, "message": {"author": {"role": "user"}, "content": {"parts": ["hi }"]}}}
    (logs / "conversations.json").write_text(json.dumps([{"id": "c", "mapping": {"a": node}}, {"id": "d", "mapping": 7}]))
    image = lambda data: {"type": "input_image", "image_url": f"data:image/png;base64,{data}"}
    (logs / "s.jsonl").write_text(json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [image("QUJD"), image("QUJD"), image("*")]}}))
    tables = providers.read_files(spark, str(logs))
    assert [r["content"] for r in tables["messages"].orderBy("content").collect()] == ["", "hi }"]
    assert sorted(r["error"].split(":")[0] for r in tables["errors"].collect()) == ["conversation d", "image 3 of event 0"]
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(tables, datetime(2024, 1, 2))
    kept = store.archive().attachments.join(store.bodies.all().withColumnRenamed("hash", "path"), "path", "left").orderBy("filename").collect()
    assert [(r["filename"], r["content"] and bytes(r["content"])) for r in kept] == [("image-1.png", b"ABC"), ("image-2.png", b"ABC"), ("image-3.png", None)]
    assert kept[2]["path"] is None and store.bodies.all().count() == 1


def test_reading_files_and_draining_an_inbox(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "s.jsonl").write_text('{"type":"user","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hello"}}\nbroken')
    (logs / "claude.json").write_text(json.dumps([{"uuid": "u", "name": "N", "chat_messages": [{"uuid": "m", "sender": "human", "text": "hey"}]}]))
    found = providers.read_files(spark, str(logs))
    assert sorted(r["content"] for r in found["messages"].collect()) == ["hello", "hey"] and found["errors"].count() == 1
    box = tmp_path / "inbox"
    box.mkdir()
    for k in range(3):
        (box / f"{k}.json").write_text(json.dumps({"source": "claude-code", "path": str(logs / "s.jsonl"), "mtime": k, "size": 1}))
    store = Store(spark, str(tmp_path / "store"))

    def parse(records):
        assert records.count() == 1
        tables = providers.read_files(spark, [r["path"] for r in records.collect()], "claude-code")
        return {t: df for t, df in tables.items() if t != "errors"}

    for _ in range(2):
        inbox.drain(spark, str(box), store, parse, str(tmp_path / "checkpoint"), lambda: datetime(2024, 1, 2)).awaitTermination()
    assert store.generation() == 1 and store.archive().messages.count() == 1
    state = spark.createDataFrame([(r["key"], r["mtime"], r["size"]) for r in inbox.coalesced(spark.read.schema(inbox.RECORD).json(str(box))).collect()], "key string, mtime long, size long")
    assert inbox.pending(spark.read.schema(inbox.RECORD).json(str(box)), state).count() == 0


def test_a_line_is_read_as_a_shell_reads_it():
    of = providers.edit_logs.of_command
    for nothing in ("echo 'a > b.py'", 'echo "x >y.sh"', "ls 2>err.log", "ls &> all.log", "x 2>&1 | tee -a log.txt", "ls # > c.py", "a > foo", "cat < in.py", "echo \\> d.py"):
        assert of(nothing) == [], nothing
    for line, path in (("echo it\\'s >> b\\ c.js", "b c.js"), ("sort < in.txt > out.csv; rm z", "out.csv"), ("echo 2 > two.txt", "two.txt"), ("(cd a && make) >| made.log", "made.log"), ("cat <<< word > h.txt", "h.txt")):
        assert of(line, "/r") == [(f"/r/{path}", "shell", line, None)], line
    assert of("cat <<-EOF | tee -a f.md\n\ta\n\tb\n\tEOF\n") == [("f.md", "write", "a\nb", None)]
    assert of("cat <<\"E O F\" > f.md\n$x\nE O F") == [("f.md", "write", "$x", None)]
    more = "cat <<EOF > a.py\nx\nEOF\npython a.py"  # what follows may change the file
    assert of(more) == [("a.py", "shell", more, None)]
    assert [c.words for c in providers.edit_logs.Shell("a 'b c'|d&&e").commands()] == [[("a", False), ("b c", True)], [("d", False)], [("e", False)]]
    broken = providers.edit_logs.Shell("a 'b")
    broken.commands()
    assert broken.broken
