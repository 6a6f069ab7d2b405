import json

from fleetlens.__main__ import main
from fleetlens.sources import sinks
from tests import fleet


def test_commands(spark, tmp_path, capsys):
    raw, lake = str(tmp_path / "raw"), str(tmp_path / "lake")
    sinks.write_chunks(fleet.metrics(spark, incidents=fleet.MIX), raw, "vm_metrics")
    sinks.write_dimension(fleet.topology(spark), f"{raw}/topology")

    main(["ingest", "--raw", raw, "--lake", lake])
    main(["history", "--lake", lake])
    out = capsys.readouterr().out
    assert "topology rows: 8" in out and "2340" in out

    main(["detect", "--lake", lake, "--asof", "30", "--json", str(tmp_path / "json"), "--digest",
          "--table", str(tmp_path / "alerts")])
    out = capsys.readouterr().out
    assert "Heap leak on patient-onboarding-0000" in out
    payload = json.loads([line for line in out.splitlines() if line.startswith('{"text"')][0])
    n = int(payload["text"].split()[1])
    assert spark.read.json(str(tmp_path / "json")).count() == n
    assert sinks.read_alerts(spark, str(tmp_path / "alerts")).count() == n

    main(["detect", "--data", raw, "--asof", "30", "--heap-limit-mb", "9000"])
    assert "Heap leak" not in capsys.readouterr().out
    main(["ask", "--data", raw, "--asof", "30", "what breaks if postgres-db goes down?"])
    assert "## Blast radius: postgres-db" in capsys.readouterr().out
    main(["sql", "--lake", lake, "SELECT count(*) AS n FROM vm_metrics"])
    assert "2340" in capsys.readouterr().out
    main(["trace", "--lake", lake, "ehr-api"])
    main(["replay", "--lake", lake])
    out = capsys.readouterr().out
    assert "postgres-db" in out and "net_retrans" in out
