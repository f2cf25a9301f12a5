"""Module-usage census of Terraform and Terragrunt code, as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function made of built-in column
expressions, so it can be chained with ``DataFrame.transform``:

    files = read_directory_tree(spark, "/data/checkouts/platform")
    calls = files.transform(module_calls)
    usage = calls.transform(usage_counts)
    usage.transform(normalized_summary)
"""
