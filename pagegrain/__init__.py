"""pagegrain: Spark jobs over tables of saved web pages, crawl responses and text corpora."""
