"""Where the small tables are."""

SF = "/root/testdata/sf0.001"
