"""DataFrame operators: linkage, fusion, categories, chapters, paths, templates, jobs."""
