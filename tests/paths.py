"""Where the tests read the given tables."""

SF = "/root/testdata/sf0.001"
