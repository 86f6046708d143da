"""Where rows come from: file trees, contents, media and the test tables."""
