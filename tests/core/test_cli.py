import json
import os

import pytest

from sealwright.__main__ import main
from sealwright.operators.seal import SealConfig, seal
from sealwright.sources.segments import write_segments

from . import vectors as v


@pytest.fixture()
def store(spark, key, vector_inputs, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    os.makedirs(folder)
    write_segments(seal(vector_inputs, key, v.SESSION, SealConfig(1024)), folder, key.key_id).collect()
    monkeypatch.setenv("A_KEY", v.SECRET.hex())
    return folder


def test_commands(spark, store, tmp_path, capsys):
    run = lambda *a: (main(list(a), spark), capsys.readouterr())
    code, out = run("verify", store, "--key-env", "A_KEY")
    assert (code, out.out) == (0, "log: Verified\n")
    code, out = run("verify", store, "--key-env", "A_KEY", "--summary")
    assert (code, out.out) == (0, f"✓ Verified · 9 events · chain head {v.ROLLOVER[-1][3][:8]}\n")
    code, out = run("head", store, "--format", "json")
    assert code == 0 and json.loads(out.out)["head_hmac_hex"] == v.ROLLOVER[-1][3]
    code, out = run("show", store, "--from", "1", "--to", "2", "--event-glob", "shield.*", "--format", "json")
    lines = [json.loads(x) for x in out.out.splitlines()]
    assert code == 0 and [(x["segment_index"], x["record_id"], x["payload"]["decision"]) for x in lines] == [(0, 1, "allow"), (1, 1, "allow")]
    code, out = run("show", store, "--actor", "nobody")
    assert code == 0 and out.err == "(0 records shown)\n"
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert run("export", store, "--key-env", "A_KEY", "--out", a)[1].err == run("export", store, "--key-env", "A_KEY", "--out", b)[1].err != ""
    path = f"{store}/log/audit-0001.cbor"
    data = bytearray(open(path, "rb").read())
    data[100] ^= 1
    open(path, "wb").write(data)
    code, out = run("verify", store, "--key-env", "A_KEY", "--format", "json")
    assert code == 1 and json.loads(out.out)["status"] == "tampered"
    assert run("verify", store, "--key-env", "A_KEY", "--segment", "0")[0] == 0
    assert run("verify", store, "--key-env", "A_KEY", "--segment", "1")[0] == 1


def test_exit_codes(spark, store, capsys):
    assert main(["version"], spark) == 0
    assert main(["verify", store, "--key-env", "NO_SUCH"], spark) == 3
    assert main(["verify", store, "--key-env", "A_KEY", "--segment", "70000"], spark) == 3
    assert main(["head", store + "-missing"], spark) == 2
    with pytest.raises(SystemExit) as e:
        main(["frobnicate"], spark)
    assert e.value.code == 64
