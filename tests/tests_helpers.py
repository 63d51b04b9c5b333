"""Versions and requests that several test modules share."""

VERSIONS = "file_uid string, version string, ord int, name string, mime string, content binary"


def two_versions(spark, uids):
    rows = [(u, f"v{2 - k}", k, "t.txt", "text/plain", bytearray(f"{u}\n{k}".encode())) for u in uids for k in range(2)]
    return spark.createDataFrame(rows, VERSIONS)


def requests_of(spark, uids):
    return spark.createDataFrame([(u, "", "") for u in uids], "file_uid string, target string, base string")
