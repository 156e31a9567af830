"""Weights of the block classifier, as html_train prints them, in the order of html_blocks.FEATURES."""

WEIGHTS = [
    2.959,  # bias
    -9.289,  # menu
    -9.300,  # foot
    -9.264,  # head
    -9.634,  # side
    -6.131,  # form
    -9.263,  # notice
    -23.250,  # bad_near
    0.293,  # good_near
    1.865,  # article
    3.527,  # heading
    0.391,  # item
    2.213,  # paragraph
    -5.325,  # link_share
    -0.309,  # mostly_links
    1.326,  # article_links
    -2.231,  # short
    0.150,  # long
    -1.426,  # sentences
    0.555,  # sentence_end
    0.331,  # headed_article
]
