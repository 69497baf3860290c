"""Small histories with known answers."""

from annalist import schemas as T

# Four commits of three authors.
COMMITS = [
    ("6c40597", True, "Author1", 60, 1580666336, 4, 1),
    ("6c50597", False, "Author2", 60, 1580666146, 3, 2),
    ("358604e", False, "Author1", -120, 1583449674, 2, 3),
    ("fdc28ab", False, "Author3", 0, 1185807283, 1, 4),
]

# Committer, lines, time, file.
BLAME = [
    ("Author1", 1, 1580666336, "file1.txt"),
    ("Author2", 2, 1580666146, "file2.txt"),
    ("Author1", 3, 1583449674, "file3.txt"),
    ("Author3", 4, 1185807283, "file1.txt"),
]

# File, binary, bytes, lines.
FILES = [
    ("file1.txt", False, 1, 1),
    ("file2.dat", False, 4, 2),
    ("folder/file3.log", False, 8, 3),
    ("folder/file4.txt", False, 16, 4),
]


def commits(spark, records=COMMITS, email="{}@{}.com"):
    data = [
        ("r", sha, pos, merge, name, email.format(name.lower(), name.lower()), tz, ts, 0, ins, dele)
        for pos, (sha, merge, name, tz, ts, ins, dele) in enumerate(records)
    ]
    return spark.createDataFrame(data, T.COMMITS)


def at(spark, times, names=None, offset=0):
    """Commits at given epoch seconds."""
    names = names or ["Author1"] * len(times)
    return commits(spark, [(f"c{i}", False, n, offset, t, 1, 0) for i, (t, n) in enumerate(zip(times, names))])


def blame(spark, records=BLAME):
    return spark.createDataFrame([("r", "HEAD", n, c, t, f) for n, c, t, f in records], T.BLAME)


def files(spark, records=FILES):
    return spark.createDataFrame([("r", "HEAD", f, b, s, n) for f, b, s, n in records], T.FILES)
