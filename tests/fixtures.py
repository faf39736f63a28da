"""Small point sets with known answers.

Fixed values: the inputs of worked examples, whose results are known.
"""

TWO_BLOBS = [(1, 1), (0.9, 1.1), (1.1, 0.9), (9, 9), (8.9, 9.1), (9.1, 8.9)]
STEP = [(0.8, 1), (1, 0.8), (1, 1.2), (1.2, 1), (8.8, 9), (9, 8.8), (9, 9.2), (9.2, 9)]
EMPTY = [(0, 0), (0.2, 0), (0, 0.2), (0.2, 0.2)]
SQUARES = [(0, 0), (0, 2), (2, 0), (2, 2), (8, 8), (8, 10), (10, 8), (10, 10)]


def _group(at):
    return [(at - 0.2, at), (at, at - 0.2), (at, at), (at, at + 0.2), (at + 0.2, at), (at + 0.2, at + 0.2)]


TWELVE = _group(1.0) + _group(9.0)
DEMO = _group(1.0) + _group(5.0) + _group(9.0) + _group(13.0)
# Candidate centres, and the squared error of their best fit with four centres.
RESTARTS = [
    (-0.7317086365368399, -1.7628963352893607), (1.9693375952864272, -1.603458695675816),
    (-0.8609456115113736, 0.09501216591092154), (1.024854072653738, 1.5085007195864208),
    (9.222684727683513, 0.522972230539271), (10.32012589776767, 1.2173563001258825),
    (8.34188888207252, 1.5511435300021321), (9.82159809833, -0.47592526035837635),
    (1.1533840288683153, 10.42693919665697), (-1.5325661032310243, 11.543021561294974),
    (0.22235367257533367, 9.953083760216886), (-0.6890060890089766, 10.929828071216907),
    (8.57902899185439, 9.265485605187301), (8.275916078487786, 10.25695462713237),
    (8.558225772709864, 9.360282475292909), (9.355999793734616, 8.777710827093234),
]
RESTARTS_SSE = 24.684190995687825
