import numpy as np
import pytest

from twinsieve.functions import kernels


def _red():
    x = np.zeros((100, 100, 3), np.uint8)
    x[..., 2] = 255
    return x


def _striped():
    x = np.full((100, 100, 3), 255, np.uint8)
    for r in range(0, 100, 10):
        x[r : r + 2] = 0
    return x


@pytest.mark.parametrize("method", ["phash", "dhash", "ahash", "whash"])
def test_hash_of_equal_pictures(method):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (90, 120, 3), dtype=np.uint8)
    assert kernels.image_hash(x, method) == kernels.image_hash(x.copy(), method)
    assert kernels.image_hash(x, method) != kernels.image_hash(x[::-1], method)


def test_resize_keeps_flat_pictures_and_weights_sum_to_one():
    assert (kernels.resize(_red(), 256, 256) == np.array([0, 0, 255])).all()
    for n_in, n_out in ((100, 8), (8, 32), (7, 7)):
        for kind in ("bicubic", "lanczos"):
            assert np.allclose(kernels.resample_weights(n_in, n_out, kind).sum(axis=1), 1)
    assert np.array_equal(kernels.resize(_striped(), 100, 100), _striped())


def test_grid_hashes_by_hand():
    grid = np.arange(64, dtype=float).reshape(1, 8, 8)
    assert kernels.grid_hashes(grid, "ahash")[0] == 0xFFFFFFFF
    assert kernels.grid_hashes(grid, "dhash")[0] == (1 << 56) - 1
    assert kernels.grid_hashes(grid, "whash")[0] == 0xFFFFFFFF
    with pytest.raises(ValueError):
        kernels.grid_hashes(grid, "none")


def test_dct_has_orthogonal_rows():
    d = kernels.dct_matrix(8)
    gram = d @ d.T
    assert np.allclose(gram, np.diag(np.diag(gram)))


def test_histogram_correlation():
    a, b = kernels.colour_histogram(_red()), kernels.colour_histogram(_striped())
    assert np.linalg.norm(a) == pytest.approx(1)
    m = kernels.correlation(np.stack([a, b]), np.stack([a, b]))
    assert m[0, 0] == pytest.approx(1) and 0 <= m[0, 1] < 0.5
    flat = np.ones((1, 8))
    assert kernels.correlation(flat, np.arange(8.0)[None])[0, 0] == 1


def test_ssim_range_and_identity():
    a, b = kernels.resize(_red(), 256, 256), kernels.resize(_striped(), 256, 256)
    assert kernels.ssim(a, a) == pytest.approx(1)
    assert kernels.ssim(a, b) < 0.9
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (20, 20)).astype(np.uint8)
    y = rng.integers(0, 256, (20, 20)).astype(np.uint8)
    want = []
    for i in range(14):
        for j in range(14):
            p, q = x[i : i + 7, j : j + 7].astype(float), y[i : i + 7, j : j + 7].astype(float)
            cov = np.cov(p.ravel(), q.ravel())
            c1, c2 = 6.5025, 58.5225
            want.append((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    assert kernels.ssim(x, y) == pytest.approx(np.mean(want))


def test_key_points_match_themselves():
    rng = np.random.default_rng(5)
    g = kernels.resize(np.kron(rng.integers(0, 2, (32, 32)) * 255, np.ones((8, 8))).astype(np.uint8), 256, 256)
    at, words = kernels.key_points(g)
    assert 0 < len(at) <= 300 and words.shape == (len(at), 4)
    unique = np.unique(words, axis=0)
    assert kernels.mutual_match_ratio(unique, unique) == 1.0
    assert kernels.mutual_match_ratio(words, words[:0]) == 0.0
    assert kernels.key_points(np.full((64, 64), 9, np.uint8))[1].shape == (0, 4)


def test_vectors():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(8, 2048))
    assert np.allclose(np.diag(kernels.cosine_score(v, v)), 1)
    zero = np.zeros((1, 2048))
    assert np.allclose(kernels.cosine_score(zero, v), 0.5)
    a, b = np.zeros((8, 2048)), np.zeros((8, 2048))
    a[:, :1024], b[:, 1024:] = 1, 1
    assert kernels.mean_max(kernels.cosine_score(a, a)) == pytest.approx(1, abs=1e-5)
    assert kernels.mean_max(kernels.cosine_score(a, b)) == pytest.approx(0.5)
    assert kernels.mean_max(np.empty((0, 8))) == 0.0
    assert kernels.hamming_score(np.array([0]), np.array([-1]))[0, 0] == 0.0
